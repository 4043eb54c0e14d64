"""Validation of a DataFrame of identifiers.

All calls are one narrow transformation: broadcast joins to the catalog's small tables and
expressions over the row, no shuffle and no Python, so they hold for a stream as for a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpident.operators.alphabets import ASCII_WHITESPACE, LOWER, UPPER, WHITESPACE
from corpident.operators.columns import translate
from corpident.operators.integers import consists_of
from corpident.plans import catalog
from corpident.plans.model import Definition
from corpident.plans.ruleset import Ruleset
from corpident.plans.tables import tables

from . import evaluate

STEP = "struct<level: string, status: string, reason_code: string, message_key: string>"

#: Codes that a register list may hold.
MOST_CODES = 100_000


@dataclass(frozen=True)
class Registers:
    """Lists that formats refer to. german: register court codes; they are many and change, so
    they are given, not kept here. Without them a German EUID that is right otherwise is
    unsupported (unsupported_format): what is not known is never invalid."""

    german: Sequence[str] | None = None
    french: Sequence[str] = tuple(catalog.FRENCH_REGISTERS)
    british: Sequence[str] = tuple(catalog.BRITISH_PREFIXES)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Registers:
        """german from a text file, one code per line. A list of more than MOST_CODES is no
        register list, and an error: cut short, it would call valid identifiers invalid."""
        rows = spark.read.text(path).select(F.trim("value").alias("code")).where("code <> ''").distinct().limit(MOST_CODES + 1).collect()
        if len(rows) > MOST_CODES:
            raise ValueError(f"{path} holds more than {MOST_CODES} codes")
        return cls(german=tuple(sorted(r[0] for r in rows)))

    def listed(self) -> Column:
        """Whether the part of the value that the rule's list is about is on it; NULL if that is not known."""
        name, register, head = F.col("r_list"), F.coalesce("e_register", F.lit("")), F.substring("e_canonical", 1, 2)
        german = F.lit(None).cast("boolean") if self.german is None else register.isin(*self.german)
        return F.when(name == "french", register.isin(*self.french)).when(name == "british", head.isin(*self.british)).when(name == "german", german)


_built: dict[tuple, Any] = {}


def _kept(spark: SparkSession, name: str, build: Callable[[], Any]) -> Any:
    """What reads names and fixed tables only, built once per session: building takes longer than running a small query."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def _blank(c: str) -> Column:
    return F.lit(None).cast(c)


def _upper(c: Column) -> Column:
    return translate(c, LOWER, UPPER)


def _canonical(df: DataFrame) -> tuple[DataFrame, Column]:
    """The definition's canonicalization of the pre-canonical value."""
    col, v = F.col, F.col("e_c")
    df = df.withColumn("e_c", translate(F.when(col("r_upper"), _upper(col("e_pre"))).otherwise(col("e_pre")), col("r_remove")))
    df = df.withColumn("e_c", F.when(F.startswith(v, col("r_replace")), F.concat(col("r_replacement"), F.substring(v, F.length("r_replace") + 1, F.length(v)))).otherwise(v))
    # a lambda ends a stage of generated code, here in time: one stage for all would be a method too large for the JIT
    accepted = F.exists("r_prefixes", lambda p: F.startswith(v, p))
    df = df.withColumn("e_c", F.when(~col("r_prepend") | accepted, v).otherwise(F.concat("r_prefix", v)))
    at = col("r_insert_at")
    fits = (F.length(v) == col("r_insert_length")) & consists_of(F.substring(v, at + 1, F.length(v)), "0123456789")
    return df, F.when(fits, F.concat(F.substring(v, F.lit(1), at), "r_insert", F.substring(v, at + 1, F.length(v)))).otherwise(v)


def resolve(df: DataFrame, kind: str, value: str, country: str | None, profile: str | Column | None, definitions: list[Definition] | None, ruleset: Ruleset | None = None) -> DataFrame:
    """df with the columns of dispatch: e_kind, e_canonical, e_country, e_profile, e_status and
    e_reason (NULL once a rule is selected), and the rule's columns r_*."""
    col, spark = F.col, df.sparkSession
    if ruleset is not None:
        t = ruleset.tables(spark)
    else:
        t = _kept(spark, "tables", lambda: tables(spark)) if definitions is None else tables(spark, definitions)
    asked = _blank("string") if profile is None else F.lit(profile) if profile in catalog.PROFILES else col(profile) if isinstance(profile, str) else profile
    asked = F.when(asked.isin(*catalog.PROFILES), asked)
    raw_country = _blank("string") if country is None else col(country)
    # the caller's columns travel in one struct, so that no name of theirs can clash
    df = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("e_row"),
        col(value).cast("string").alias("e_value"),
        raw_country.cast("string").alias("e_raw_country"),
        asked.alias("e_asked"),
        translate(F.btrim(col(kind), F.lit(ASCII_WHITESPACE)), UPPER, LOWER).alias("e_token"),
    )
    utf8, short = F.is_valid_utf8("e_value"), F.octet_length("e_value") <= catalog.MAX_INPUT_BYTES
    df = df.join(F.broadcast(t.kinds), (col("e_token") == col("k_token")) & utf8 & short, "left")
    token = _upper(F.btrim(col("e_raw_country"), F.lit(ASCII_WHITESPACE)))
    bare = translate(col("e_value"), WHITESPACE)
    df = df.withColumns(
        {
            "e_country_token": F.when(token != "", token),
            "e_pre": translate(_upper(bare), col("k_remove")) if ruleset is None else ruleset.pre(col("e_value")),
            "e_bare": bare,
        }
    )
    df = df.join(F.broadcast(t.countries), F.concat("k_kind", F.lit("/"), "e_country_token") == col("c_key"), "left")
    # the longest prefix that fits decides
    for n in t.prefix_lengths:
        own = t.prefixes.where(F.length("p_prefix") == n).select(F.col("p_key").alias(f"p_key{n}"), F.col("p_target").alias(f"p_target{n}"))
        df = df.join(F.broadcast(own), F.concat("k_kind", F.lit("/"), F.substring("e_pre", 1, n)) == col(f"p_key{n}"), "left")
    df = df.withColumn("p_target", F.coalesce(*[f"p_target{n}" for n in t.prefix_lengths], F.lit(None).cast("string")))
    given, shaped = col("e_country_token").isNotNull(), (F.length("e_country_token") == 2) & consists_of(col("e_country_token"), UPPER)
    reason = (
        F.when(~utf8, "invalid_encoding")
        .when(~short, "input_too_long")
        .when(col("k_kind").isNull(), "unsupported_kind")
        .when(given & ~shaped, "unsupported_country")
        .when(given & col("c_target").isNull() & col("k_specific"), "unsupported_country")
        .when(col("c_target") != col("p_target"), "country_mismatch")
        .when(F.coalesce("c_target", "p_target", "k_fallback").isNull(), "missing_country_code")
    )
    df = df.withColumn("e_reason", reason)
    df = df.withColumn("e_target", F.when(col("e_reason").isNull(), F.coalesce("c_target", "p_target", "k_fallback")))
    df = df.join(F.broadcast(t.rules), col("e_target") == col("target"), "left")
    profile_used = F.coalesce("e_asked", "r_profile", F.lit("compatible"))
    df, canonical = _canonical(df) if ruleset is None else (df, ruleset.canonical(col("e_pre"), profile_used))
    resolved = F.coalesce("c_country", "e_country_token")
    early = F.coalesce(col("e_reason").isin("invalid_encoding", "input_too_long", "unsupported_kind"), F.lit(False))
    df = df.withColumn("e_canonical", F.when(early, col("e_value")).when(col("e_reason").isNotNull(), col("e_pre")).otherwise(canonical))
    country_code = F.when(early | (given & ~shaped), col("e_raw_country")).when(col("e_reason").isNotNull(), resolved).otherwise(F.coalesce("r_country", resolved))
    keep = [c for c in df.columns if c.startswith("r_") or c == "target"]
    return df.select(
        "e_row",
        "e_value",
        "e_canonical",
        "e_reason",
        *keep,
        F.coalesce("k_kind", "e_token").alias("e_kind"),
        country_code.alias("e_country"),
        profile_used.alias("e_profile"),
        F.when(col("e_reason") == "country_mismatch", "invalid").when(col("e_reason").isNotNull(), "unsupported").alias("e_status"),
    )


def _common(ruleset: Ruleset | None) -> list[Column]:
    col = F.col
    return [
        col("e_kind").alias("kind"),
        col("e_value").alias("input_value"),
        col("e_canonical").alias("canonical_value"),
        col("e_country").alias("country_code"),
        col("e_profile").alias("profile"),
        F.lit(catalog.RULES_VERSION if ruleset is None else ruleset.version).alias("rules_version"),
        F.lit(catalog.FORMAT_VERSION).alias("format_version"),
        F.lit(catalog.ENGINE_VERSION).alias("engine_version"),
    ]


def _step(level: str, status: Column, reason: Column, key: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), status.alias("status"), reason.alias("reason_code"), key.alias("message_key"))


def canonicalize(df: DataFrame, kind: str = "kind", value: str = "value", country: str | None = "country_code", profile: str | Column | None = None, definitions: list[Definition] | None = None, ruleset: Ruleset | None = None) -> DataFrame:
    """df with a struct column canonicalization; a NULL value gives NULL."""
    found = resolve(df, kind, value, country, profile, definitions, ruleset)
    result = F.struct(*_common(ruleset), F.coalesce("e_status", F.lit("valid")).alias("status"), F.coalesce("e_reason", F.lit("ok")).alias("reason_code"), _blank("string").alias("message_key"))
    return found.select(*[F.col(f"e_row.`{c}`").alias(c) for c in df.columns], F.when(F.col("e_value").isNotNull(), result).alias("canonicalization"))


def validate(
    df: DataFrame,
    kind: str = "kind",
    value: str = "value",
    country: str | None = "country_code",
    profile: str | Column | None = None,
    registers: Registers | None = None,
    run_checksum: bool = True,
    definitions: list[Definition] | None = None,
    ruleset: Ruleset | None = None,
) -> DataFrame:
    """df with a struct column report: the common fields, format and checksum (each level,
    status, reason_code, message_key), is_format_valid, is_checksum_valid, is_fully_validated
    and is_invalid. A NULL value gives a NULL report, a NULL kind is an unsupported kind.

    profile: a profile's name, a column that holds one, or None for each definition's own.
    ruleset: a loaded bundle, whose programs then take the place of the catalog's definitions.
    """
    col, lists = F.col, registers or Registers()
    found = resolve(df, kind, value, country, profile, definitions, ruleset)
    if ruleset is not None:
        return _reported(df, _judged(found, ruleset, run_checksum), run_checksum, ruleset)
    spark, euid, selected = df.sparkSession, col("r_euid").isNotNull(), col("target").isNotNull()
    found = found.withColumns({"e_register": F.when(euid, evaluate.register(col("e_canonical"), col("r_euid"))), "e_tail": F.when(euid, evaluate.tail(col("e_canonical")))})
    found = found.withColumns({"e_listed": lists.listed(), "e_head": F.when(selected, _kept(spark, "head", evaluate.head_failure))})
    # what needs lambdas is done in one step, over lists that are joined for it alone
    nested = _kept(spark, "tables", lambda: tables(spark)) if definitions is None else tables(spark, definitions)
    found = found.join(F.broadcast(nested.lists), F.when(col("e_head").isNull(), col("target")) == col("l_target"), "left")
    summed = F.when(col("l_target").isNotNull() & col("r_absence").isNull(), _kept(spark, "checksum", evaluate.checksum)) if run_checksum else F.lit(None).cast(evaluate.OUTCOME)
    found = found.withColumns({"e_rest": F.when(col("l_rest").isNotNull(), _kept(spark, "rest", evaluate.rest_failure)), "e_sum": summed}).drop("l_target", "l_rest", "l_sum", "l_parts")
    headless, known = col("e_head").isNotNull(), F.coalesce(col("e_rest.known"), F.lit(True))
    failed = headless | col("e_rest").isNotNull()
    status = F.when(~selected, col("e_status")).when(failed & known, "invalid").when(failed, "unsupported").otherwise("valid")
    reason = F.when(~selected, col("e_reason")).when(headless, _kept(spark, "reason", evaluate.head_reason)).when(failed & known, col("e_rest.reason_code")).when(failed, "unsupported_format").otherwise("ok")
    key = F.when(headless, _kept(spark, "key", evaluate.head_key)).when(failed & known, col("e_rest.message_key"))
    return _reported(df, found.withColumn("e_format", _step("format", status, reason, key)), run_checksum)


def _judged(found: DataFrame, ruleset: Ruleset, run_checksum: bool) -> DataFrame:
    """found with e_format and e_sum by a bundle's programs. What they read is NULL where no
    rule is selected, and checksums only see valid formats."""
    col, selected = F.col, F.col("target").isNotNull()
    found = found.withColumn("e_rest", ruleset.format(col("e_canonical"), col("e_profile")))
    failed = col("e_rest").isNotNull()
    status = F.when(~selected, col("e_status")).when(failed, "invalid").otherwise("valid")
    reason = F.when(~selected, col("e_reason")).when(failed, col("e_rest.reason_code")).otherwise("ok")
    found = found.withColumn("e_format", _step("format", status, reason, F.when(failed, col("e_rest.message_key"))))
    summed = ruleset.checksum(col("e_canonical"), col("e_profile")) if run_checksum else F.lit(None).cast(evaluate.OUTCOME)
    return found.withColumn("e_sum", F.when(col("e_format.status") == "valid", summed))


def _reported(df: DataFrame, found: DataFrame, run_checksum: bool, ruleset: Ruleset | None = None) -> DataFrame:
    """df with report, from e_format and e_sum."""
    col = F.col
    not_run = lambda why: _step("checksum", F.lit("not_run"), F.lit(why), _blank("string"))
    absent = _step("checksum", F.lit("unsupported"), col("r_absence"), _blank("string"))
    ran = not_run("not_requested")
    if run_checksum:
        ran = F.when(col("r_absence").isNotNull(), absent).otherwise(_step("checksum", col("e_sum.status"), col("e_sum.reason_code"), col("e_sum.message_key")))
    checksum = F.when(col("e_format.status") == "invalid", not_run("not_run_format_invalid")).when(col("e_format.status") == "unsupported", not_run("not_run_format_unsupported")).otherwise(ran)
    found = found.withColumn("e_checksum", checksum)
    format_valid, checksum_valid = col("e_format.status") == "valid", col("e_checksum.status") == "valid"
    report = F.struct(
        *_common(ruleset),
        col("e_format").alias("format"),
        col("e_checksum").alias("checksum"),
        format_valid.alias("is_format_valid"),
        checksum_valid.alias("is_checksum_valid"),
        (format_valid & checksum_valid).alias("is_fully_validated"),
        ((col("e_format.status") == "invalid") | (col("e_checksum.status") == "invalid")).alias("is_invalid"),
    )
    return found.select(*[F.col(f"e_row.`{c}`").alias(c) for c in df.columns], F.when(col("e_value").isNotNull(), report).alias("report"))


def validate_format(df: DataFrame, **how) -> DataFrame:
    """As validate, without the checksum of valid formats (not_requested)."""
    return validate(df, **how, run_checksum=False)


def validate_checksum(df: DataFrame, **how) -> DataFrame:
    """As validate: a checksum is only run on a valid format."""
    return validate(df, **how)


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in catalog.CAPABILITIES], "capability int")


def rules_info(spark: SparkSession) -> DataFrame:
    """One row: versions, number of definitions and countries, kinds in order."""
    own = catalog.definitions()
    countries = {d.country for d in own} - {"GLOBAL"}
    row = (catalog.RULES_VERSION, catalog.FORMAT_VERSION, catalog.ENGINE_VERSION, len(own), len(countries), sorted(catalog.KINDS))
    return spark.createDataFrame([row], "rules_version string, format_version int, engine_version string, definition_count int, country_count int, kinds array<string>")
