"""Sources, sinks, streams and conformance cases."""

import json

from corpident import functions as api
from corpident import sources, streaming

SCHEMA = "kind string, value string, country_code string, profile string"
ROWS = [("siren", "012345674", None, None), ("vat", "BE0123456749", "FR", None), ("lei", "x", None, "strict_current")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for kind in ("json", "parquet"):
        df.write.format(kind).save(str(tmp_path / kind))
        got = sources.read_identifiers(spark, str(tmp_path / kind), kind)
        assert sorted(map(tuple, got.select(*SCHEMA.replace(" string", "").split(", ")).collect()), key=str) == sorted(ROWS, key=str)
    reports = api.validate(df, profile="profile")
    sources.write_reports(reports, str(tmp_path / "out"), "json")
    assert {json.loads(r.value)["kind"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"siren", "vat", "lei"}
    sources.write_reports(reports, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"))
    query = streaming.write_stream(streaming.validate_stream(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    batch = api.flatten(api.validate(spark.read.parquet(str(tmp_path / "in")), profile="profile"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_conformance_cases(spark):
    cases = [(f"c{i}", o, *ROWS[0]) for i, o in enumerate(["canonicalize", "validate", "validate_format", "validate_checksum", "load", None])]
    cases.append(("p", "validate", "siren", "1", None, "other"))
    got = {r.id: json.loads(r.response) for r in sources.respond(spark.createDataFrame(cases, sources.CASE)).collect()}
    assert len(got) == 7 and got["c0"]["status"] == "valid" and got["c1"] == got["c3"]
    assert got["c2"]["checksum"]["reason_code"] == "not_requested"
    assert got["c4"] == got["c5"] == {"failure": "unknown operation"} and got["p"] == {"failure": "unknown profile"}


def test_cases_that_load_bundles(spark):
    from tests.test_language import bundle

    newer = {**bundle(), "format_version": 2}
    rows = [("good", json.dumps(bundle())), ("newer", json.dumps(newer)), ("cut", json.dumps(bundle())[:-3]), ("none", None)]
    cases = [(i, "load_ruleset", None, None, None, None, payload) for i, payload in rows] + [("v", "validate", *ROWS[0], None)]
    got = {r.id: json.loads(r.response) for r in sources.respond(spark.createDataFrame(cases, sources.LOAD_CASE)).collect()}
    assert got.pop("v")["kind"] == "siren"
    assert got == {"good": {"accepted": True}, "newer": {"accepted": False, "engine_error": "incompatible_ruleset"}, "cut": {"accepted": False, "engine_error": "invalid_ruleset"}, "none": {"accepted": False, "engine_error": "invalid_ruleset"}}
