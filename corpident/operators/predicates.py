"""Conditions on views. Never NULL: every one but is_absent is false on an absent view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import BASE36, DIGITS, UPPER
from .integers import consists_of


def _firm(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_empty(s: Column) -> Column:
    return _firm(s == "")


def is_absent(s: Column) -> Column:
    return s.isNull()


def equals(a: Column, b: Column) -> Column:
    return _firm(a == b)


def length_eq(s: Column, n: int) -> Column:
    return _firm(F.length(s) == n)


def length_in(s: Column, lengths: Sequence[int]) -> Column:
    return _firm(F.length(s).isin(*lengths))


def length_between(s: Column, least: int, most: int) -> Column:
    return _firm(F.length(s).between(least, most))


def ascii_digits(s: Column) -> Column:
    return consists_of(s, DIGITS)


def ascii_upper_letters(s: Column) -> Column:
    return consists_of(s, UPPER)


def ascii_alphanumeric(s: Column) -> Column:
    return consists_of(s, BASE36)


def ascii_charset(s: Column, chars: str) -> Column:
    return consists_of(s, chars)


def starts_with(s: Column, text: str) -> Column:
    return _firm(F.startswith(s, F.lit(text)))


def ends_with(s: Column, text: str) -> Column:
    return _firm(F.endswith(s, F.lit(text)))


def prefix_in(s: Column, texts: Sequence[str]) -> Column:
    """Starts with one of the texts: a hash lookup for each of their lengths."""
    by_length: dict[int, list[str]] = {}
    for t in texts:
        by_length.setdefault(len(t), []).append(t)
    tests = [(F.length(s) >= n) & F.substring(s, 1, n).isin(*own) for n, own in sorted(by_length.items())]
    return _firm(reduce(lambda a, b: a | b, tests)) if tests else F.lit(False)


def char_at_in(s: Column, index: int, chars: str) -> Column:
    c = F.substring(s, index + 1, 1)
    return _firm((F.length(s) > index) & (F.instr(F.lit(chars), c) > 0))


def contains(s: Column, text: str) -> Column:
    return _firm(F.contains(s, F.lit(text)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def not_(condition: Column) -> Column:
    return ~condition


def profile_is(profile: Column, name: str) -> Column:
    return _firm(profile == name)


def integer_is(i: Column, constant: int) -> Column:
    return _firm(i == constant)
