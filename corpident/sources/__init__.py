"""Where identifiers come from and reports go: any source and sink of Spark, and JSON cases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpident import functions as api
from corpident.plans import checks

INPUT = "kind string, value string, country_code string, profile string"
CASE = f"id string, operation string, {INPUT}"
#: With a bundle, for cases that load one.
LOAD_CASE = f"{CASE}, rules_payload string"


def read_identifiers(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """kind, value, country_code, profile (absent columns are NULL) and what else is there."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(INPUT) if format in ("json", "csv") else reader).load(path)
    missing = {c: F.lit(None).cast("string") for c in ("country_code", "profile") if c not in df.columns}
    return df.withColumns(missing) if missing else df


def write_reports(df: DataFrame, path: str, format: str = "parquet", column: str = "report") -> None:
    """Reports as a table, or for json and text one JSON object a row without absent fields."""
    if format in ("json", "text"):
        df.select(F.to_json(column).alias("value")).write.text(path)
    else:
        api.flatten(df).write.format(format).save(path)


def _loaded(payload: str | None) -> str:
    """Checks of one bundle; there is no expression for them, and cases are few."""
    try:
        checks.load((payload or "").encode())
    except (checks.InvalidRuleset, checks.IncompatibleRuleset) as e:
        return json.dumps({"accepted": False, "engine_error": e.code})
    return json.dumps({"accepted": True})


def respond(cases: DataFrame, registers: api.Registers | None = None) -> DataFrame:
    """id, response: the JSON that each conformance case calls for. cases: see CASE or LOAD_CASE. The
    operation is canonicalize, validate, validate_format, validate_checksum or load_ruleset
    (of rules_payload, a bundle, which is accepted or not, with the engine's error); any other,
    or a profile that is not known, gives {"failure": ...}."""
    if "rules_payload" not in cases.columns:
        cases = cases.withColumn("rules_payload", F.lit(None).cast("string"))
    loads = F.col("operation") == "load_ruleset"
    known = F.col("operation").isin("canonicalize", "validate", "validate_format", "validate_checksum")
    good = known & (F.col("profile").isNull() | F.col("profile").isin("compatible", "strict_current"))
    each = []
    for operation, f in (("canonicalize", api.canonicalize), ("validate_format", api.validate_format), ("validate", api.validate)):
        own = F.col("operation") == operation if operation != "validate" else F.col("operation").isin("validate", "validate_checksum")
        how = {} if operation == "canonicalize" else {"registers": registers}
        done = f(cases.where(good & own), profile="profile", **how)
        each.append(done.select("id", F.to_json(done.columns[-1]).alias("response")))
    each.append(cases.where(loads).select("id", F.udf(_loaded, "string")("rules_payload").alias("response")))
    bad = cases.where(~F.coalesce(good | loads, F.lit(False)))
    each.append(bad.select("id", F.to_json(F.struct(F.when(known, "unknown profile").otherwise("unknown operation").alias("failure"))).alias("response")))
    out = each[0]
    for other in each[1:]:
        out = out.unionByName(other)
    return out
