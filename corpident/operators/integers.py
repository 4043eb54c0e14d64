"""Integers from strings. NULL is indeterminate, and stays so through every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import BASE36, DIGITS

LEFT, RIGHT, CYCLE = "left", "right", "cycle"


def consists_of(s: Column, alphabet: Column | str) -> Column:
    """Present, not empty, and made of the alphabet only; never NULL. Trimming the alphabet off
    the front leaves nothing then; unlike translate it builds no table for each new alphabet."""
    return F.coalesce((s != "") & (F.ltrim(s, F.lit(alphabet) if isinstance(alphabet, str) else alphabet) == ""), F.lit(False))


def digits_to_integer(s: Column) -> Column:
    return F.when(consists_of(s, DIGITS), s.try_cast("bigint"))


def mod_digits(s: Column, modulus: int | Column) -> Column:
    """The remainder of a number of any length."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    folded = F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * 10 + c.try_cast("bigint"), m)))
    short = F.pmod(s.try_cast("bigint"), m)
    return F.when(consists_of(s, DIGITS), F.when(F.length(s) <= 18, short).otherwise(folded))


def weighted_sum(s: Column, weights: Sequence[int] | Column, alignment: str | Column = LEFT, alphabet: str | Column = DIGITS) -> Column:
    """Sum of the characters' places in the alphabet times their weights. LEFT and RIGHT pair
    from that end as far as both go, CYCLE repeats the weights. A character outside the
    alphabet, paired or not, makes it indeterminate, and so does an overflow."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(int(x)).cast("bigint") for x in weights])
    letters = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
    how = F.lit(alignment) if isinstance(alignment, str) else alignment
    n, m = F.length(s), F.size(w)
    first = F.when(how == RIGHT, F.greatest(n - m, F.lit(0))).otherwise(F.lit(0))
    last = F.when(how == LEFT, F.least(n, m)).otherwise(n)

    def add(total: Column, i: Column) -> Column:
        at = F.when(how == CYCLE, F.pmod(i, m)).when(how == RIGHT, i + m - n).otherwise(i)
        place = (F.instr(letters, F.substring(s, i + 1, F.lit(1))) - 1).cast("bigint")
        return F.try_add(total, F.try_multiply(place, F.get(w, at)))

    total = F.aggregate(F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"), add)
    return F.when(consists_of(s, letters) & (m > 0), total)


def base36_sum(s: Column, weights: Sequence[int], alignment: str = LEFT) -> Column:
    return weighted_sum(s, weights, alignment, BASE36)


def modulo(i: Column, modulus: int | Column) -> Column:
    return F.pmod(i, F.lit(modulus) if isinstance(modulus, int) else modulus)


def complement(i: Column, modulus: int | Column) -> Column:
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.when((i >= 0) & (i <= m), (m - i).cast("bigint"))


def remainder_map(i: Column, values: Sequence[int] | Column) -> Column:
    table = values if isinstance(values, Column) else F.array(*[F.lit(int(x)).cast("bigint") for x in values])
    return F.when((i >= 0) & (i < F.size(table)), F.get(table, i.cast("int")))
