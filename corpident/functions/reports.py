"""Shapes of reports: flat columns, JSON, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = ("kind", "input_value", "canonical_value", "country_code", "profile", "rules_version", "format_version", "engine_version")
STEP = ("status", "reason_code", "message_key")
DERIVED = ("is_format_valid", "is_checksum_valid", "is_fully_validated", "is_invalid")


def flatten(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and the report's fields, those of steps as format_status and so on."""
    r = lambda c: F.col(f"report.{c}")
    steps = [r(f"{s}.{c}").alias(f"{s}_{c}") for s in ("format", "checksum") for c in STEP]
    return df.select(*keep, *[r(c).alias(c) for c in FLAT], *steps, *[r(c).alias(c) for c in DERIVED])


def report_json(df: DataFrame, column: str = "report") -> DataFrame:
    """df with the struct as JSON text; absent fields are left out."""
    return df.withColumn(column, F.to_json(column))


def verdict_summary(df: DataFrame, *by: str) -> DataFrame:
    """Rows by kind, format and checksum status (and by), counted."""
    return df.groupBy(*by, F.col("report.kind").alias("kind"), F.col("report.format.status").alias("format_status"), F.col("report.checksum.status").alias("checksum_status")).agg(F.count("*").alias("n"))
