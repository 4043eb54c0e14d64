"""Canonicalization steps: functions from the value so far to the next value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import LOWER, UPPER, WHITESPACE
from .columns import translate

Step = Callable[[Column], Column]


def steps(*each: Step) -> Step:
    def run(v: Column) -> Column:
        for step in each:
            v = step(v)
        return v

    return run


def trim_whitespace() -> Step:
    return lambda v: F.btrim(v, F.lit(WHITESPACE))


def remove_whitespace() -> Step:
    return lambda v: translate(v, WHITESPACE)


def uppercase_ascii() -> Step:
    return lambda v: translate(v, LOWER, UPPER)


def remove_chars(chars: str | Column) -> Step:
    return lambda v: translate(v, chars)


def replace_prefix(text: str, replacement: str) -> Step:
    return lambda v: F.when(F.startswith(v, F.lit(text)), F.concat(F.lit(replacement), F.substring(v, F.lit(len(text) + 1), F.length(v)))).otherwise(v)


def prepend(text: str) -> Step:
    return lambda v: F.concat(F.lit(text), v)


def append(text: str) -> Step:
    return lambda v: F.concat(v, F.lit(text))


def insert(index: int, text: str) -> Step:
    """Nothing happens if the value is shorter than index."""
    return lambda v: F.when(F.length(v) >= index, F.concat(F.substring(v, 1, index), F.lit(text), F.substring(v, F.lit(index + 1), F.length(v)))).otherwise(v)


def left_pad(length: int, char: str) -> Step:
    return lambda v: F.when(F.length(v) < length, F.lpad(v, length, char)).otherwise(v)


def prepend_country_if_missing(prefixes: Sequence[str] | Column, canonical: str | Column) -> Step:
    def run(v: Column) -> Column:
        accepted = prefixes if isinstance(prefixes, Column) else F.array(*[F.lit(p) for p in prefixes]).cast("array<string>")
        own = F.lit(canonical) if isinstance(canonical, str) else canonical
        return F.when(F.exists(accepted, lambda p: F.startswith(v, p)), v).otherwise(F.concat(own, v))

    return run


def when(predicate: Callable[[Column], Column], *each: Step) -> Step:
    run = steps(*each)
    return lambda v: F.when(predicate(v), run(v)).otherwise(v)


CANONICAL_STEPS = (steps, trim_whitespace, remove_whitespace, uppercase_ascii, remove_chars, replace_prefix, prepend, append, insert, left_pad, prepend_country_if_missing, when)
