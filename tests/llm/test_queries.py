"""The registered queries, and the pipeline stage by stage, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpident.llm import packing, queries, token_counts
from tests.llm.test_dedup_ops import plain_components, plain_cut, plain_fingerprint, plain_jaccard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE[name])
    names = [x[0] for x in cursor.description]
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == expected


def test_op2(spark):
    import hashlib

    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, SF).collect()}
    for (i, _), (n, spans, kept) in zip(rows, plain_cut(rows)):
        assert got[i] == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_op10(spark):
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in table(spark, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(fps, plain_components(fps))}


def test_op8(spark):
    import numpy as np

    from tests.llm.test_record_ops import plain_neighbours

    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings").collect() if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in queries.op8_ann(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        a, b = x[ids == r.query_id][0], x[ids == r.vec_id][0]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel=1e-12)
    plain = plain_neighbours(ids, x, ids % 50 == 0, 5)
    assert set(got) == set(plain) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(plain[q])) for q in plain) >= 0.9 * 5 * len(plain)


def test_op9(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    got = [r for r in queries.op9_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.9 * len(got)


def test_op4(spark):
    with open(token_counts.VOCABULARY, "rb") as f:
        count = token_counts.counter(f.read())
    rows = table(spark, "documents").select("doc_id", "text", queries.op4_edits().alias("edits")).collect()
    got = {r.doc_id: r for r in queries.op4_token_counts(spark, SF).collect()}
    for r in rows:
        text = r.text
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_pretokens) == count(text)
        for e in r.edits:
            start = min(e.start, len(text))
            text = text[:start] + e.text + text[max(start, min(e.stop, len(text))) :]
        assert (got[r.doc_id].n_chars_edited, got[r.doc_id].n_tokens_edited, got[r.doc_id].n_pretokens_edited) == (len(text), *count(text))


def test_pipeline_stages(spark):
    """Each stage on what the one before kept; the last packs all of it."""
    import corpus_pipeline

    from corpident.llm import common

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "mix", "pack"]
    docs = table(spark, "documents")
    columns, was = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        if name == "quality":
            known = [i for i in was if i in labels]
            kept = {r.doc_id for r in rows}
            assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
        elif name == "near_duplicates":
            # five-word shingles of similarity 0.8 or more, not operator 10's bits
            pairs = sorted(was.items())
            assert {r.doc_id for r in rows} == {i for (i, _), c in zip(pairs, plain_jaccard(pairs)) if i == c}
        elif name == "repeated_strings":
            pairs = sorted(was.items())
            bytes_kept = {i: kept for (i, _), (_, _, kept) in zip(pairs, plain_cut(pairs))}
            assert {r.doc_id for r in rows} == set(was)
            # only parts of characters at the edges of a span stay beyond what is cut
            assert all(0 <= len(r.text.encode()) - len(bytes_kept[r.doc_id]) <= 4 * 50 for r in rows)
        else:
            times = Counter(r.doc_id for r in rows)
            assert set(times) <= set(was) and max(times.values()) <= 2
        was = {r.doc_id: r.text for r in rows}
        last = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.counter(f.read()).encode
    assert Counter((r.doc_id, r.start + i, t) for r in packed for i, t in enumerate(r.tokens)) == Counter((r.doc_id, i, t) for r in last for i, t in enumerate(encode(r.text or "")))
    assert all(r.length == len(r.tokens) <= r.padded for r in packed)


def test_op3(spark):
    """The whole query against a plain version: the same pieces, boundaries, order and batches."""
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.counter(f.read()).encode
    plain = []
    for r in table(spark, "documents").collect():
        own = encode(r.text or "")
        plain += [(len(own[a : a + packing.MAX_LEN]), r.doc_id, a // packing.MAX_LEN, own[a : a + packing.MAX_LEN]) for a in range(0, len(own), packing.MAX_LEN)]
    ends = packing.boundaries(list(Counter(p[0] for p in plain).items()), packing.N_BUCKETS)
    expected, nth = {}, Counter()
    for n, i, piece, own in sorted(plain):
        padded = next(e for e in ends if n <= e)
        room = packing.BUDGET // padded
        expected[i, piece] = (n, padded, nth[padded] // room, nth[padded] % room, own)
        nth[padded] += 1
    got = {(r.doc_id, r.piece): (r.length, r.padded, r.batch, r.slot, list(r.tokens)) for r in queries.op3_packing(spark, SF).collect()}
    assert got == expected


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, ties and columns of clashing names, stage by stage."""
    import corpus_pipeline

    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.counter(f.read()).encode
    docs, labels = table(spark, "documents"), table(spark, "labels")
    whole = lambda r: tuple(r[c] for c in docs.columns)
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.limit(12).union(docs.limit(3)).collect()
    odd = [tuple(None for _ in docs.columns), *[tuple(None if c == gone else r[c] for c in docs.columns) for gone in docs.columns for r in rows[:3]], *map(tuple, rows)]
    names = ["row", "id", "v", "g", "n", "key", "score", "kept", "copies", "component_id", "tokens", "_gone", "spans", "c0", "x0"]
    for own in (docs.limit(0), spark.createDataFrame(odd, docs.schema).withColumns({c: F.lit(c) for c in names})):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, own, str(tmp_path))
            assert done.columns == own.columns, name
            got = done.collect()
            if own.columns[-1] == "x0":
                assert got and all(r[c] == c for r in got for c in names), name
                if name in ("quality", "repeated_strings"):
                    assert len(got) == len(odd)
                elif name == "near_duplicates":
                    # the smallest id of each group stays, and what has no id
                    roots = plain_jaccard([(r[0], r[1]) for r in odd])
                    assert Counter(map(whole, got)) == Counter(tuple(r) for r, c in zip(odd, roots) if r[0] is None or r[0] == c)
                else:
                    # each row at most twice, words or not
                    most, seen = Counter(map(tuple, odd)), Counter(map(whole, got))
                    assert all(n <= 2 * most[r] for r, n in seen.items())
            else:
                assert not got
        packed = Counter()
        for r in corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path)).collect():
            packed[r.doc_id] += len(r.tokens)
        expected = Counter()
        for r in odd if own.columns[-1] == "x0" else []:
            expected[r[0]] += len(encode(r[1] or ""))
        assert packed == Counter({i: n for i, n in expected.items() if n})
