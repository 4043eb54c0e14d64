"""Built-in functions whose Python wrappers take literals only, for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def translate(s: Column, chars: Column | str, to: str = "") -> Column:
    """s with each of chars replaced by the one at its place in to, or deleted."""
    return F.call_function("translate", s, F.lit(chars) if isinstance(chars, str) else chars, F.lit(to))


def luhn_check(s: Column) -> Column:
    return F.call_function("luhn_check", s)
