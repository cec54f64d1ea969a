"""Column functions of the library in one place."""

from ..operators.metrics import format_duration, grade
from ..operators.patches import hashed, natural_key
from ..operators.pixels import rounded

__all__ = ["format_duration", "grade", "hashed", "natural_key", "rounded"]
