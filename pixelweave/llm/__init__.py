"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle_sql`` live in :mod:`pixelweave.llm.entry`.
"""
