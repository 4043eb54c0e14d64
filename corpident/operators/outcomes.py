"""Checksum outcomes: valid, invalid or unsupported; NULL where a branch does not apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import BASE36, DIGITS
from .columns import luhn_check
from .integers import consists_of, digits_to_integer

TYPE = "struct<status: string, reason_code: string, message_key: string>"


def outcome(status: str, reason: str, key: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason_code"), F.lit(key).cast("string").alias("message_key"))


def valid() -> Column:
    return outcome("valid", "ok")


def unsupported(reason: str = "unsupported_checksum", key: str | None = None) -> Column:
    return outcome("unsupported", reason, key)


def _verdict(known: Column, holds: Column, key: str | None) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), unsupported()).when(holds, valid()).otherwise(outcome("invalid", "invalid_checksum", key))


def luhn(s: Column, key: str | None = None) -> Column:
    return _verdict((F.length(s) >= 2) & consists_of(s, DIGITS), luhn_check(s), key)


def mod97_remainder(s: Column) -> Column:
    """The number modulo 97 where letters are two digits, A 10 to Z 35, nine digits at a time."""
    number = s
    for i, letter in enumerate(BASE36[10:], 10):
        number = F.replace(number, F.lit(letter), F.lit(str(i)))
    blocks = F.greatest(F.ceil(F.length(number) / 9).cast("int"), F.lit(1))

    def step(r: Column, block: Column) -> Column:
        return (r * 1_000_000_000 + block.try_cast("bigint")) % 97

    def fold(padded: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(padded) / 9).cast("int") - 1), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)))
        return F.aggregate(parts, F.lit(0).cast("bigint"), step)

    return F.get(F.transform(F.array(F.lpad(number, blocks * 9, F.lit("0"))), fold), F.lit(0))


def mod97_10(s: Column, key: str | None = None) -> Column:
    return _verdict((F.length(s) >= 3) & consists_of(s, BASE36), mod97_remainder(s) == 1, key)


def compare_digit(i: Column, s: Column, index: int, key: str | None = None) -> Column:
    digit = digits_to_integer(F.when(F.length(s) > index, F.substring(s, index + 1, 1)))
    return _verdict(i.isNotNull() & digit.isNotNull(), i == digit, key)


def compare_slice(i: Column, s: Column, start: int, end: int, key: str | None = None) -> Column:
    number = digits_to_integer(F.when(F.length(s) >= end, F.substring(s, start + 1, end - start)))
    return _verdict(i.isNotNull() & number.isNotNull(), i == number, key)


def compare_constant(i: Column, constant: int, key: str | None = None) -> Column:
    return _verdict(i.isNotNull(), i == constant, key)


def when(condition: Column, then: Column) -> Column:
    return F.when(condition, then)


def choose(*branches: Column) -> Column:
    return F.coalesce(*branches, unsupported())


def _first(outcomes: tuple[Column, ...], status: str) -> list[Column]:
    return [F.when(o["status"] == status, o) for o in outcomes]


def all_checks(*outcomes: Column) -> Column:
    return F.coalesce(*_first(outcomes, "invalid"), *_first(outcomes, "unsupported"), valid())


def any_check(*outcomes: Column) -> Column:
    return F.coalesce(*_first(outcomes, "valid"), *_first(outcomes, "unsupported"), *_first(outcomes, "invalid"), unsupported())


def call_checksum(program, s: Column) -> Column:
    """Another checksum program, with s as its subject."""
    return program(s)
