"""Bundles: one that is accepted, and one defect for each check."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from corpident.functions import Ruleset, canonicalize, validate
from corpident.plans import checks, language
from corpident.plans.checks import IncompatibleRuleset, InvalidRuleset


def bundle():
    n = lambda op, *operands, **params: {"op": op, "in": list(operands), **params}
    return {
        "format_version": 1,
        "required_feature_ids": [1, 2, 3, 11, 20, 30, 31],
        "rules_version": "1.0",
        "source_digest": "ab" * 32,
        "programs": [
            {"id": 1, "kind": "pre_canonicalization", "nodes": [n("canonicalization_remove_whitespace"), n("canonicalization_sequence", 0)], "root": 1},
            {"id": 2, "kind": "canonicalization", "nodes": [n("canonicalization_remove_chars", chars="-")], "root": 0},
            {
                "id": 3,
                "kind": "format",
                "nodes": [n("string_subject"), n("predicate_ascii_digits", 0), n("assertion_require", 1, reason_code="invalid_characters", message_key="k"), n("predicate_length_eq", 0, length=9), n("assertion_require", 3, reason_code="invalid_length"), n("assertion_sequence", 2, 4)],
                "root": 5,
            },
            {"id": 4, "kind": "checksum", "nodes": [n("string_subject"), n("checksum_luhn", 0)], "root": 1},
            {"id": 5, "kind": "checksum", "nodes": [n("string_value"), n("call_checksum", 0, program=4)], "root": 1},
        ],
        "definitions": [{"id": "a", "kind": "thing", "country": "FR", "canonicalization": 2, "format": 3, "checksum": 5, "default_profile": "compatible", "sources": [{"url": "x"}]}],
        "dispatchers": [{"kind": "thing", "aliases": ["fr_thing"], "pre_canonicalization": 1, "country_aliases": {}, "targets": [{"country": "FR", "definition": "a", "prefixes": [], "canonical_prefix": "FR"}]}],
    }


def load(b):
    return checks.load(json.dumps(b).encode())


def test_accepted():
    assert load(bundle())["rules_version"] == "1.0"
    assert len(language.OPS) == 63


def put(path, value):
    def change(b):
        *way, last = path
        for k in way:
            b = b[k]
        b[last] = value

    return change


def drop(path):
    def change(b):
        *way, last = path
        for k in way:
            b = b[k]
        del b[last]

    return change


DEFECTS = [
    (3, put(["format_version"], 2)),
    (4, put(["required_feature_ids"], [1, 2, 99])),
    (4, put(["required_feature_ids"], [2, 1])),
    (5, put(["other"], 1)),
    (5, put(["programs", 0, "other"], 1)),
    (6, put(["rules_version"], "a b")),
    (6, put(["rules_version"], "a" * 65)),
    (7, put(["source_digest"], "ab")),
    (8, put(["programs", 1, "id"], 1)),
    (8, put(["programs", 1, "kind"], "none")),
    (9, put(["programs", 1, "nodes"], [{"op": "canonicalization_remove_whitespace"}] * 4097)),
    (10, put(["programs", 1, "nodes", 0, "op"], "nothing")),
    (11, put(["programs", 2, "nodes", 1, "in"], [1])),
    (11, put(["programs", 2, "nodes", 1, "in"], [])),
    (11, put(["programs", 2, "nodes", 2, "in"], [0])),
    (12, put(["programs", 2, "nodes", 1, "text"], "x")),
    (12, drop(["programs", 2, "nodes", 3, "length"])),
    (13, put(["programs", 2, "nodes", 3, "length"], 5000)),
    (13, put(["programs", 2, "nodes", 2, "message_key"], "")),
    (13, put(["programs", 2, "nodes", 2, "reason_code"], "invalid_checksum")),
    (13, put(["programs", 3, "nodes"], [{"op": "string_subject"}, {"op": "integer_digits_to_integer", "in": [0]}, {"op": "checksum_compare_constant", "in": [1], "constant": 0}])),
    (14, put(["programs", 2, "nodes"], [{"op": "string_subject"}, {"op": "predicate_is_empty", "in": [0]}, *[{"op": "predicate_all", "in": [i, i]} for i in range(1, 20)], {"op": "assertion_require", "in": [20], "reason_code": "empty"}])),
    (15, put(["programs", 1, "root"], 7)),
    (15, put(["programs", 3, "subject"], 0)),
    (15, put(["programs", 3, "captures"], [{"name": "x", "node": 1}])),
    (16, put(["programs", 2, "root"], 1)),
    (16, put(["programs", 0, "nodes", 0], {"op": "canonicalization_prepend", "text": "x"})),
    (16, put(["programs", 3, "nodes"], [{"op": "string_subject"}, {"op": "checksum_luhn", "in": [0]}, {"op": "predicate_is_empty", "in": [0]}, {"op": "checksum_when", "in": [2, 1]}, {"op": "checksum_all_checks", "in": [3]}]) or None),
    (17, put(["definitions", 0, "country"], "fr")),
    (17, put(["definitions", 0, "sources"], [])),
    (18, put(["definitions", 0, "absence"], "checksum_not_published")),
    (18, drop(["definitions", 0, "checksum"])),
    (19, put(["dispatchers", 0, "aliases"], ["thing"])),
    (20, put(["dispatchers", 0, "country_aliases"], {"FR": "FR"})),
    (21, put(["dispatchers", 0, "targets"], [])),
    (22, put(["dispatchers", 0, "targets", 0, "country"], "GLOBAL")),
    (23, put(["dispatchers", 0, "targets", 0, "definition"], "b")),
    (24, put(["programs", 3, "nodes", 1], {"op": "call_checksum", "in": [0], "program": 5})),
    (24, put(["programs", 4, "nodes", 1, "program"], 3)),
    (25, put(["required_feature_ids"], [1, 2, 3, 11, 20, 30])),
]


@pytest.mark.parametrize(("number", "change"), DEFECTS)
def test_defects(number, change):
    b = copy.deepcopy(bundle())
    change(b)
    if number == 16 and b["programs"][3]["root"] != len(b["programs"][3]["nodes"]) - 1:
        b["programs"][3]["root"] = len(b["programs"][3]["nodes"]) - 1
    if number == 22:
        b["dispatchers"][0]["targets"][0]["prefixes"] = ["XX"]
        b["definitions"][0]["country"] = "GLOBAL"
    if number in (13, 14):
        for p in b["programs"]:
            p["root"] = min(p["root"], len(p["nodes"]) - 1)
        b["programs"][2]["root"] = len(b["programs"][2]["nodes"]) - 1
        b["programs"][3]["root"] = len(b["programs"][3]["nodes"]) - 1
    unknown = number == 3 or (number == 4 and 99 in b["required_feature_ids"])
    with pytest.raises(IncompatibleRuleset if unknown else InvalidRuleset, match=f"check {number}:"):
        load(b)


def test_not_json_and_too_large():
    with pytest.raises(InvalidRuleset, match="check 2"):
        checks.load(b"{")
    with pytest.raises(InvalidRuleset, match="check 1"):
        checks.load(b" " * (checks.MAX_BUNDLE + 1))


@pytest.mark.parametrize(
    ("number", "change"),
    [(6, put(["rules_version"], 5)), (7, put(["source_digest"], None)), (4, put(["required_feature_ids"], None)), (9, drop(["programs", 0, "nodes"])), (8, put(["programs", 1, "id"], "2")), (5, put(["programs"], {"a": 1})), (5, put(["dispatchers", 0, "targets"], "x"))],
)
def test_values_of_the_wrong_type(number, change):
    b = bundle()
    change(b)
    with pytest.raises(InvalidRuleset, match=f"check {number}:"):
        load(b)


def test_hostile_bundles_raise_the_two_errors_only():
    import random

    rng = random.Random(1)
    odd = [None, True, -1, 1 << 70, 1.5, "", "x", [], {}, [None], [[1]], {"op": 3}, "\ud800", [{}]]

    def spoil(x):
        if isinstance(x, (dict, list)) and x and rng.random() < 0.85:
            key = rng.choice(list(x) if isinstance(x, dict) else range(len(x)))
            if rng.random() < 0.1:
                del x[key]
            else:
                x[key] = spoil(x[key])
            return x
        return copy.deepcopy(rng.choice(odd))

    for _ in range(3000):
        b = spoil(bundle())
        try:
            load(b)
        except (InvalidRuleset, IncompatibleRuleset):
            pass
    for data in (b"[" * 100_000, b'{"a":' * 50_000, b"\xff", b"1", b"null", b'{"format_version": true}'):
        with pytest.raises((InvalidRuleset, IncompatibleRuleset)):
            checks.load(data)


def test_compiled_programs(spark):
    b = load(bundle())
    programs = {p["id"]: p for p in b["programs"]}
    run = lambda i: language.compile_program(programs[i], programs)
    rows = spark.createDataFrame([("012 345-674",), ("01234567",), ("01234567x",)], "s string")
    step = lambda i, c: run(i)(language.Context(c))(c)
    value = step(2, step(1, F.col("s")))
    got = rows.select(value.alias("v"), run(3)(language.Context(value)).alias("a"), run(5)(language.Context(value)).alias("o")).collect()
    assert [(r.v, r.a and r.a.reason_code, r.o.status) for r in got] == [("012345674", None, "valid"), ("01234567", "invalid_length", "invalid"), ("01234567x", "invalid_characters", "unsupported")]


def test_every_operation_compiles(spark):
    """One program of each kind that uses all operations."""
    n = lambda op, *operands, **params: {"op": op, "in": list(operands), **params}
    k = {"message_key": "k"}
    text = [n("string_constant", text="AB12"), n("string_value"), n("string_subject"), n("string_country_code"), n("string_slice", 1, start=0, end=2), n("string_slice_from", 1, start=1), n("string_slice_to", 1, end=3), n("string_before_first", 1, text="."), n("string_after_first", 1, text="."), n("string_strip_prefix", 1, text="1"), n("string_concat", 4, 6)]
    ints = [n("integer_digits_to_integer", 4), n("integer_mod_digits", 1, modulus=97), n("integer_weighted_sum", 1, weights=[1, 2], alignment="left", mapping="alnum_base36"), n("integer_modulo", 11, modulus=7), n("integer_complement", 14, modulus=7), n("integer_remainder_map", 14, values=[1, 2, 3, 4, 5, 6, 7])]
    tests = [n("predicate_is_empty", 1), n("predicate_is_absent", 1), n("predicate_equals", 1, 2), n("predicate_length_eq", 1, length=3), n("predicate_length_in", 1, lengths=[1, 3]), n("predicate_length_between", 1, min=1, max=3), n("predicate_ascii_digits", 1), n("predicate_ascii_upper_letters", 1), n("predicate_ascii_alphanumeric", 1), n("predicate_ascii_charset", 1, chars="12"), n("predicate_starts_with", 1, text="1"), n("predicate_ends_with", 1, text="1"), n("predicate_prefix_in", 1, texts=["1", "2"]), n("predicate_char_at_in", 1, index=0, chars="1"), n("predicate_contains", 1, text="1"), n("predicate_profile_is", profile="compatible")]
    base = len(text) + len(ints)
    tests += [n("predicate_all", base, base + 1), n("predicate_any", base, base + 2), n("predicate_not", base), n("predicate_integer_is", 14, constant=1)]
    at = base + len(tests)
    sums = [n("checksum_luhn", 1, **k), n("checksum_iso7064_mod97_10", 1), n("checksum_compare_digit", 14, 1, index=0), n("checksum_compare_slice", 14, 1, start=0, end=2), n("checksum_compare_constant", 14, constant=3), n("checksum_unsupported", reason_code="checksum_not_published"), n("checksum_when", base, at), n("checksum_choose", at + 6, at + 1), n("checksum_all_checks", at, at + 1), n("checksum_any_check", at + 2, at + 3), n("call_checksum", 1, program=2), n("checksum_all_checks", at + 7, at + 8, at + 9, at + 10, at + 4, at + 5)]
    steps = [n("canonicalization_trim_whitespace"), n("canonicalization_remove_whitespace"), n("canonicalization_uppercase_ascii"), n("canonicalization_remove_chars", chars="-"), n("canonicalization_replace_prefix", text="1", replacement="2"), n("canonicalization_prepend", text="x"), n("canonicalization_append", text="x"), n("canonicalization_insert", index=1, text="y"), n("canonicalization_left_pad", length=9, pad="0"), n("canonicalization_prepend_country_if_missing"), n("string_value"), n("predicate_length_eq", 10, length=3), n("canonicalization_when", 11, 5), n("canonicalization_sequence", *range(10), 12)]
    programs = {
        1: {"id": 1, "kind": "checksum", "nodes": [*text, *ints, *tests, *sums], "root": at + len(sums) - 1},
        2: {"id": 2, "kind": "checksum", "nodes": [n("string_subject"), n("checksum_luhn", 0)], "root": 1},
        3: {"id": 3, "kind": "canonicalization", "nodes": steps, "root": len(steps) - 1},
        4: {"id": 4, "kind": "format", "nodes": [n("string_value"), n("predicate_is_empty", 0), n("assertion_require", 1, reason_code="empty"), n("assertion_sequence", 2), n("call_format", 0, program=5), n("assertion_sequence", 3, 4)], "root": 5},
        5: {"id": 5, "kind": "format", "nodes": [n("string_subject"), n("predicate_is_absent", 0), n("assertion_require", 1, reason_code="invalid_format")], "root": 2},
    }
    used = {m["op"] for p in programs.values() for m in p["nodes"]}
    assert used == set(language.OPS)
    rows = spark.createDataFrame([("1230",), ("",), (None,)], "s string")
    c = language.Context(F.col("s"), prefixes=("FR",), prefix="FR")
    out = rows.select(*[language.compile_program(programs[i], programs)(c).alias(f"r{i}") for i in (1, 2, 4)], language.compile_program(programs[3], programs)(c)(F.col("s")).alias("v")).collect()
    assert len(out) == 3 and out[0].v == "FR0xy2230x"[:2] + out[0].v[2:]


def two_countries():
    """The bundle with a second kind: prefixes of two lengths, an alias of a country, a definition without a checksum."""
    n = lambda op, *operands, **params: {"op": op, "in": list(operands), **params}
    b = bundle()
    b["required_feature_ids"] = [1, 2, 3, 5, 11, 20, 21, 30, 31]
    b["programs"] += [
        {"id": 6, "kind": "canonicalization", "nodes": [n("canonicalization_prepend_country_if_missing")], "root": 0},
        {"id": 7, "kind": "format", "nodes": [n("string_value"), n("string_country_code"), n("predicate_profile_is", profile="strict_current"), n("predicate_length_eq", 0, length=6), n("predicate_not", 2), n("predicate_any", 3, 4), n("assertion_require", 5, reason_code="invalid_length"), n("predicate_starts_with", 0, text="X"), n("predicate_not", 7), n("assertion_require", 8, reason_code="invalid_format"), n("assertion_sequence", 6, 9)], "root": 10},
    ]
    own = {"canonicalization": 6, "format": 7, "absence": "checksum_not_published", "sources": [{"url": "x"}]}
    b["definitions"] += [{"id": f"b_{c.lower()}", "kind": "tool", "country": c, "default_profile": "compatible", **own} for c in ("BE", "GR")]
    targets = [{"country": "BE", "definition": "b_be", "prefixes": ["BE", "BEL1"], "canonical_prefix": "BE"}, {"country": "GR", "definition": "b_gr", "prefixes": ["EL"], "canonical_prefix": "EL"}]
    b["dispatchers"].append({"kind": "tool", "aliases": ["tool_no"], "pre_canonicalization": 1, "country_aliases": {"EL": "GR"}, "targets": targets})
    return b


def test_a_loaded_bundle_validates(spark):
    cases = [
        # kind, value, country, profile: canonical, country, format, checksum
        ("thing", "732-829 320", None, None, ("732829320", "FR", "ok", "ok")),
        (" FR_Thing", "732829321", "fr", None, ("732829321", "FR", "ok", "invalid_checksum")),
        ("thing", "73282932", None, None, ("73282932", "FR", "invalid_length", "not_run_format_invalid")),
        ("thing", "73282932x", None, None, ("73282932x", "FR", "invalid_characters", "not_run_format_invalid")),
        ("thing", "7 3", "DE", None, ("73", "DE", "unsupported_country", "not_run_format_unsupported")),
        ("tool", "BE 1234", None, None, ("BE1234", "BE", "ok", "checksum_not_published")),
        ("tool", "BEL12", None, "strict_current", ("BEL12", "BE", "invalid_length", "not_run_format_invalid")),
        ("tool", "1234", "EL", None, ("EL1234", "GR", "ok", "checksum_not_published")),
        ("tool_no", "EL1", "BE", None, ("EL1", "BE", "country_mismatch", "not_run_format_invalid")),
        ("tool", "1234", None, None, ("1234", None, "missing_country_code", "not_run_format_unsupported")),
        ("siren", "73 2829320", None, None, ("73 2829320", None, "unsupported_kind", "not_run_format_unsupported")),
        (None, "1", None, None, ("1", None, "unsupported_kind", "not_run_format_unsupported")),
        ("thing", "1" * 1025, None, None, ("1" * 1025, None, "input_too_long", "not_run_format_unsupported")),
        ("thing", None, None, None, None),
    ]
    rules = Ruleset(json.dumps(two_countries()).encode())
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "target int, kind string, value string, country_code string, profile string")
    got = validate(rows, profile="profile", ruleset=rules).orderBy("target").collect()
    seen = [r.report and (r.report.canonical_value, r.report.country_code, r.report.format.reason_code, r.report.checksum.reason_code) for r in got]
    assert seen == [c[4] for c in cases]
    assert {r.report.rules_version for r in got if r.report} == {"1.0"}
    assert got[2].report.format.status == "invalid" and got[3].report.format.message_key == "k" and got[0].report.is_fully_validated
    some = validate(rows, profile="profile", ruleset=rules, run_checksum=False).where("target in (0, 5)").collect()
    assert {r.report.checksum.reason_code for r in some} == {"not_requested"}
    values = [r.canonicalization and r.canonicalization.canonical_value for r in canonicalize(rows, ruleset=rules).orderBy("target").collect()]
    assert values == [c[4] and c[4][0] for c in cases]
    assert validate(rows.limit(0), ruleset=rules).count() == 0


def test_a_bundle_agrees_with_the_catalog(spark):
    """The same rule as a program and as a row of the catalog."""
    b = bundle()
    b["dispatchers"][0] |= {"kind": "siren", "aliases": []}
    b["definitions"][0]["kind"] = "siren"
    n = lambda op, *operands, **params: {"op": op, "in": list(operands), **params}
    b["programs"][0]["nodes"] = [n("canonicalization_remove_whitespace"), n("canonicalization_uppercase_ascii"), n("canonicalization_remove_chars", chars="-./_"), n("canonicalization_sequence", 0, 1, 2)]
    b["programs"][0]["root"] = 3
    values = ["732829320", "732 829-320", "73282932", "73282932A", "732829321", "٧" * 9, "356000000", None]
    rows = spark.createDataFrame([(v, c) for v in values for c in (None, "FR", "fr ", "DE", "FRA")], "value string, country_code string").withColumn("kind", F.lit("siren"))

    def reports(**how):
        out = validate(rows, **how).select("value", "country_code", F.col("report.canonical_value"), F.col("report.country_code").alias("c"), *[F.col(f"report.{x}.{y}").alias(f"{x}_{y}") for x in ("format", "checksum") for y in ("status", "reason_code")])
        return sorted(map(str, out.collect()))

    assert reports(ruleset=Ruleset(json.dumps(b).encode())) == reports()
