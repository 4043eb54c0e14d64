"""Assertions: NULL where they hold, else why not. Only five reasons prove a format invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVING = ("empty", "invalid_length", "invalid_characters", "invalid_format", "country_mismatch")
TYPE = "struct<reason_code: string, message_key: string>"


def failure(reason: str, key: str | None = None) -> Column:
    return F.struct(F.lit(reason).alias("reason_code"), F.lit(key).cast("string").alias("message_key"))


def require(condition: Column, reason: str, key: str | None = None) -> Column:
    if reason not in PROVING:
        raise ValueError(f"{reason} does not prove a format invalid")
    return F.when(~condition, failure(reason, key))


def sequence(*assertions: Column) -> Column:
    """The first that fails."""
    return F.coalesce(*assertions)


def call_format(program, s: Column) -> Column:
    """Another format program, with s as its subject."""
    return program(s)
