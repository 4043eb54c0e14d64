"""The engine on stated cases, and its invariants on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from corpident import functions as api
from corpident.plans import catalog

SCHEMA = "kind string, value string, country_code string, profile string"

# kind, value, country, profile -> canonical, country, format reason, format key, checksum status, checksum reason
CASES = [
    (("siren", "  012 345-674  ", None, None), ("012345674", "FR", "ok", None, "valid", "ok")),
    (("siren", "01234567", None, None), ("01234567", "FR", "invalid_length", "fr.siren.length", "not_run", "not_run_format_invalid")),
    (("siren", "", None, None), ("", "FR", "empty", "fr.siren.empty", "not_run", "not_run_format_invalid")),
    (("siren", "01234567A", None, None), ("01234567A", "FR", "invalid_characters", "fr.siren.characters", "not_run", "not_run_format_invalid")),
    (("  SIREN\t", "012345674", None, None), ("012345674", "FR", "ok", None, "valid", "ok")),
    (("fr_siren", "012345675", None, None), ("012345675", "FR", "ok", None, "invalid", "invalid_checksum")),
    (("siren", "012 345 674", "DE", None), ("012345674", "DE", "unsupported_country", None, "not_run", "not_run_format_unsupported")),
    (("siren", "012345674", "Deutschland", None), ("012345674", "Deutschland", "unsupported_country", None, "not_run", "not_run_format_unsupported")),
    (("siren", "012345674", " \t", None), ("012345674", "FR", "ok", None, "valid", "ok")),
    (("siren", "é" * 512, None, None), ("é" * 512, "FR", "invalid_length", "fr.siren.length", "not_run", "not_run_format_invalid")),
    (("siren", "é" * 513, "FR", None), ("é" * 513, "FR", "input_too_long", None, "not_run", "not_run_format_unsupported")),
    (("no_such_kind", " X ", None, None), (" X ", None, "unsupported_kind", None, "not_run", "not_run_format_unsupported")),
    ((None, "1", None, None), ("1", None, "unsupported_kind", None, "not_run", "not_run_format_unsupported")),
    (("vat", "BE 0123.456.749", None, None), ("BE0123456749", "BE", "ok", None, "valid", "ok")),
    (("vat", "BE 123.456.749", None, None), ("BE0123456749", "BE", "ok", None, "valid", "ok")),
    (("vat", "BE0123456749", "FR", None), ("BE0123456749", "FR", "country_mismatch", None, "not_run", "not_run_format_invalid")),
    (("vat", "gr 012345670", None, None), ("EL012345670", "GR", "ok", None, "valid", "ok")),
    (("vat", "09 012345674", "FR", None), ("FR09012345674", "FR", "ok", None, "valid", "ok")),
    (("vat", "FRXX012345674", None, None), ("FRXX012345674", "FR", "ok", None, "unsupported", "checksum_not_published")),
    (("vat", "FRXX012345674", None, "strict_current"), ("FRXX012345674", "FR", "invalid_characters", "vat.fr.key_characters", "not_run", "not_run_format_invalid")),
    (("vat", "0123456749", None, None), ("0123456749", None, "missing_country_code", None, "not_run", "not_run_format_unsupported")),
    (("vat", "ATU01234567", None, None), ("ATU01234567", "AT", "ok", None, "unsupported", "unsupported_checksum")),
    (("lei", "0000-0000-0000-0000-0098", "fr", None), ("00000000000000000098", "FR", "ok", None, "valid", "ok")),
    (("lei", "0000-0000-0000-0000-0098", None, None), ("00000000000000000098", None, "ok", None, "valid", "ok")),
    (("cegjegyzekszam", "0123456789", None, None), ("0123456789", "HU", "ok", None, "unsupported", "checksum_not_published")),
    (("company_number", "ZZ123456", None, None), ("ZZ123456", "GB", "invalid_format", "company_number.prefix", "not_run", "not_run_format_invalid")),
    (("euid", "FR9999.012345674", None, None), ("FR9999.012345674", "FR", "invalid_format", "euid.fr.register_unknown", "not_run", "not_run_format_invalid")),
    (("euid", "FRTVX.012345675", None, None), ("FRTVX.012345675", "FR", "invalid_length", "euid.fr.register_length", "not_run", "not_run_format_invalid")),
    (("euid", "FR7501.01234567", None, None), ("FR7501.01234567", "FR", "invalid_length", "fr.siren.length", "not_run", "not_run_format_invalid")),
    (("euid", "FR7501.012345674", "FR", None), ("FR7501.012345674", "FR", "ok", None, "valid", "ok")),
    (("euid", "GR1.1", "GR", None), ("GR1.1", "GR", "unsupported_country", None, "not_run", "not_run_format_unsupported")),
    (("siret", "35600000000048", None, None), ("35600000000048", "FR", "ok", None, "valid", "ok")),
]


def test_stated_cases(spark):
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], f"i int, {SCHEMA}")
    got = api.validate(rows, profile="profile").orderBy("i").select("report.*").collect()
    for (given, expected), r in zip(CASES, got):
        assert (r.canonical_value, r.country_code, r.format.reason_code, r.format.message_key, r.checksum.status, r.checksum.reason_code) == expected, given
        assert r.input_value == given[1]


def test_german_registers_are_a_parameter(spark, tmp_path):
    rows = spark.createDataFrame([("euid", "DEK1101R.HRB116737", None), ("euid", "DEZZZZZ.HRB12345", None), ("euid", "DEZZ.HRB12345", None)], "kind string, value string, country_code string")
    of = lambda **how: [(r.report.format.status, r.report.format.reason_code) for r in api.validate(rows, **how).collect()]
    assert of() == [("unsupported", "unsupported_format"), ("unsupported", "unsupported_format"), ("invalid", "invalid_length")]
    (tmp_path / "codes.txt").write_text("K1101R\nB1000\n\n")
    assert of(registers=api.Registers.read(spark, str(tmp_path / "codes.txt"))) == [("valid", "ok"), ("invalid", "invalid_format"), ("invalid", "invalid_length")]


def test_register_lists_are_never_cut_short(spark, tmp_path, monkeypatch):
    from corpident.functions import engine

    (tmp_path / "courts").write_text("\n".join(f"B{i:04d}" for i in range(30)) + "\n\n B0001 \n")
    assert len(api.Registers.read(spark, str(tmp_path / "courts")).german) == 30
    monkeypatch.setattr(engine, "MOST_CODES", 29)
    with pytest.raises(ValueError, match="more than 29"):
        api.Registers.read(spark, str(tmp_path / "courts"))


def test_the_longest_prefix_decides(spark):
    from dataclasses import replace

    from corpident.plans import catalog

    own = [d for d in catalog.definitions() if d.kind == "vat" and d.country in ("BE", "FR", "DE")]
    given = {"BE": ("A",), "FR": ("ABC",), "DE": ("AB", "D")}
    own = [replace(d, prefixes=given[d.country], prefix=given[d.country][0]) for d in own]
    rows = spark.createDataFrame([(v,) for v in ("abc1", "AB1", "A-1", "d1", "x1", "a")], "value string").withColumns({"kind": F.lit("vat"), "country_code": F.lit(None).cast("string")})
    got = {r.value: r.canonicalization.country_code for r in api.canonicalize(rows, definitions=own).collect()}
    assert got == {"abc1": "FR", "AB1": "DE", "A-1": "BE", "d1": "DE", "x1": None, "a": "BE"}


def test_null_values_and_extra_columns(spark):
    rows = spark.createDataFrame([("siren", None, 3, 1), ("siren", "012345674", 4, 2)], "kind string, value string, e_value int, target int")
    got = api.validate(rows, country=None).orderBy("target").collect()
    assert [(r.report is None, r.e_value) for r in got] == [(True, 3), (False, 4)]
    assert api.validate(rows.limit(0), country=None).count() == 0


def test_invalid_encoding(spark):
    rows = spark.sql("SELECT 'siren' AS kind, cast(X'30ff31' AS string) AS value, 'FR' AS country_code")
    r = api.validate(rows).select("report.format.*").first()
    assert (r.status, r.reason_code) == ("unsupported", "invalid_encoding")


def test_format_only_checksum_and_canonicalize(spark):
    rows = spark.createDataFrame([("siren", "012345674", None), ("siren", "1", None)], "kind string, value string, country_code string")
    got = [r.report for r in api.validate_format(rows).collect()]
    assert [r.checksum.reason_code for r in got] == ["not_requested", "not_run_format_invalid"]
    assert [r.report for r in api.validate(rows).collect()] == [r.report for r in api.validate_checksum(rows).collect()]
    got = [r.canonicalization for r in api.canonicalize(rows).collect()]
    assert [(r.status, r.reason_code, r.canonical_value) for r in got] == [("valid", "ok", "012345674"), ("valid", "ok", "1")]


def test_rules_info(spark):
    r = api.rules_info(spark).first()
    assert (r.rules_version, r.definition_count, r.country_count, len(r.kinds)) == ("2026.08.38", 94, 37, 37)
    assert [x.capability for x in api.capabilities(spark).orderBy("capability").collect()] == list(catalog.CAPABILITIES)


def test_json_leaves_absent_fields_out(spark):
    rows = spark.createDataFrame([("lei", "x", None)], "kind string, value string, country_code string")
    text = api.report_json(api.validate(rows)).first().report
    assert "country_code" not in text and '"message_key":"lei.length"' in text


LEGAL = {
    "valid": {"ok"},
    "invalid": {"empty", "invalid_length", "invalid_characters", "invalid_format", "country_mismatch", "invalid_checksum"},
    "unsupported": {"unsupported_kind", "unsupported_country", "missing_country_code", "input_too_long", "unsupported_format", "unsupported_checksum", "checksum_not_published"},
    "not_run": {"not_requested", "not_run_format_invalid", "not_run_format_unsupported"},
}


def test_invariants_on_random_input(spark):
    rng = random.Random(7)
    alphabet = [*"0123456789ABCDEFabcdef -./_", " ", "﻿", "　", "́", "​", "\U0001f600"]
    kinds = [*catalog.KINDS, "no_such_kind"]
    rows = [(i, rng.choice(kinds), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), rng.choice([None, "FR", "de", "x"])) for i in range(600)]
    # now and then right in length and characters
    rows += [(600 + i, rng.choice(kinds), rng.choice(["", "FR", "BE", "GB", "EL"]) + "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 14))), None) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, kind string, value string, country_code string")
    got = api.validate(df).select("i", "report.*").collect()
    assert len(got) == len(rows)
    for r in got:
        for step in (r.format, r.checksum):
            assert step.reason_code in LEGAL[step.status], r
        assert (r.checksum.status == "not_run") == (r.format.status != "valid")
        assert r.is_fully_validated == (r.is_format_valid and r.is_checksum_valid)
        assert r.input_value == rows[r.i][2]
    # canonicalizing what came out changes nothing, for inputs that selected a definition
    again = spark.createDataFrame([(r.i, r.kind, r.canonical_value, r.country_code, r.canonical_value) for r in got if r.format.status != "unsupported" and r.format.reason_code != "country_mismatch" and r.kind not in ("duns", "eori", "lei")], "i int, kind string, value string, country_code string, was string")
    changed = api.canonicalize(again).where(F.col("canonicalization.canonical_value") != F.col("was")).collect()
    assert not changed


def test_one_digit_in_ten_passes(spark):
    df = spark.createDataFrame([("siren", f"01234567{d}", None) for d in range(10)], "kind string, value string, country_code string")
    assert sum(r.report.checksum.status == "invalid" for r in api.validate(df).collect()) == 9


def test_plan_has_no_shuffle_and_no_python(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("siren", "1", None)], "kind string, value string, country_code string").write.parquet(path)
    plan = api.validate(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("kind", ["siren", "vat"])
def test_separators_do_not_matter(spark, kind):
    base = "012345674" if kind == "siren" else "BE0123456749"
    texts = [base[:i] + c + base[i:] for i in range(len(base) + 1) for c in " -./ "]
    df = spark.createDataFrame([(kind, t, None) for t in texts], "kind string, value string, country_code string")
    assert {r.report.canonical_value for r in api.validate(df).collect()} == {base}
