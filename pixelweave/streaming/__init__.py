"""New slides as a stream; the library needs no further state."""

from ..sources.slides import slide_stream

__all__ = ["slide_stream"]
