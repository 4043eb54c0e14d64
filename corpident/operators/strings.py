"""Views of strings. NULL in, or a place that does not exist, gives NULL; lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(text: str) -> Column:
    return F.lit(text)


def value(canonical: Column) -> Column:
    """The canonical value, or inside canonicalization the value so far."""
    return canonical


def subject(argument: Column | None, own: Column | None, canonical: Column) -> Column:
    """The caller's argument, else the program's own subject, else the canonical value."""
    return next(x for x in (argument, own, canonical) if x is not None)


def country_code(target_country: Column) -> Column:
    return target_country


def slice_(s: Column, start: int, end: int) -> Column:
    if start > end:
        return F.lit(None).cast("string")
    return F.when(F.length(s) >= end, F.substring(s, start + 1, end - start))


def slice_from(s: Column, start: int) -> Column:
    return F.when(F.length(s) >= start, F.substring(s, F.lit(start + 1), F.length(s)))


def slice_to(s: Column, end: int) -> Column:
    return slice_(s, 0, end)


def before_first(s: Column, text: str) -> Column:
    at = F.instr(s, F.lit(text))
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1))


def after_first(s: Column, text: str) -> Column:
    at = F.instr(s, F.lit(text))
    return F.when(at > 0, F.substring(s, at + len(text), F.length(s)))


def strip_prefix(s: Column, text: str) -> Column:
    return F.when(F.startswith(s, F.lit(text)), F.substring(s, F.lit(len(text) + 1), F.length(s)))


def concat(*views: Column) -> Column:
    return F.concat(*views)
