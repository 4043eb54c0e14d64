"""Chat formatting, WARC archives and nearest neighbours against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpident.llm import ann, chat_format, warc

TURN = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|\\>im_start end\nassistant é", max_size=40), st.text(alphabet="<|\\\nab", max_size=12))
def test_turns_round_trip(text, role):
    formatted, spans, _, _ = chat_format.format_turn(role, [{"kind": "text", "text": text}])
    assert chat_format.parse_turn(formatted) == (role, text)
    body = formatted[len(chat_format.START) : -len(chat_format.END) - 1]
    assert "<|" not in body
    assert not spans or [chat_format.unescape(formatted[s["start"] : s["stop"]]) for s in spans] == [text]


def test_read_back(spark):
    rng = random.Random(1)
    odd = ["", None, "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "a\r\nb", "😀" * 50, "x" * 100_000]
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice(["user", "assistant", "system", None]), rng.choice(odd)) for i in range(60)]
    rows += [(9, 0, "assistant", "same")] * 2 + [(9, None, "user", "first")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, TURN).withColumn("n_turns", F.lit("x")))).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (-1 if r[1] is None else r[1]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], TURN))).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part("text", text="look <|image|> "), part("image", ref="a.png", width=57, height=28), None, part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3), part("video", ref="no"), part("text", text="end")]
    rows = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_turns(rows, F.col("parts")).first()
    assert r.formatted == "<|im_start|>user\nlook <\\|image|> <|image|><|audio|><|document|>end<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 4500)]
    assert all(r.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in r.attachments)
    assert r.n_tokens == 2 + 3 + 50 + 4500 + 1


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    sep = "\r\n\r\n"
    long = "".join(rng.choice(["a", "\r", "\n", sep, "é", "WARC/1.0\r\n"]) for _ in range(3000))
    texts = [None, "", "x", sep, sep + "\r\n", "\r\n" * 7, "end\r", "end\r\n", "end\r\n\r", f"WARC/1.0\r\nContent-Length: 3{sep}abc", long, long, long, "b" * 999, "b" * 999, "c" * 1000, "c" * 1000, "d" * 100_000, "\x00\x1f" * 600]
    rows = [(i, f"http://x/{i} y\r\n", t) for i, t in enumerate(texts)] + [(None, None, "c" * 1000), (16, "u", "c" * 1000), (12, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z")).repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, chunk=1000)
    chunks = warc.read(spark, path)
    got = chunks.where("last").collect()
    assert len(got) == len(rows)
    whole = {}
    for r in chunks.orderBy("chunk_no").collect():
        whole.setdefault((r.record_id, r.page_id), []).append(bytes(r.chunk))
    assert max(len(c) for own in whole.values() for c in own) <= 1000
    top = {}
    for i, _, t in rows:
        if i is not None and t is not None and len(t.encode()) >= 1000:
            top[t] = max(top.get(t, -1), i)
    expected = []
    for i, _, t in rows:
        b = (t or "").encode()
        to = top.get(t) if i is not None and len(b) >= 1000 and top[t] != i else None
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(str, expected))
    payloads = sorted(b"".join(own) for (_, i), own in whole.items() if i == 10 or i == 17)
    assert (texts[17].encode() in payloads) and all(r.record_type == "revisit" for r in got if r.page_id in (10, 11))
    empty = f"file://{tmp_path}/e"
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


@pytest.mark.parametrize("text", ["end\r\n", "\r\n", "\r\n\r\n\r\n", "a" * 999 + "\r\n"])
def test_last_page_of_a_file_ends_in_a_line_break(spark, tmp_path, text):
    """One file for each page; Spark's reader puts several of them in one partition."""
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i, "u", text) for i in range(3)], "page_id long, url string, html string").repartitionByRange(3, "page_id")
    warc.write(pages, path, chunk=1000, min_revisit=1 << 20)
    got = warc.read(spark, path).where("last").collect()
    expected = hashlib.sha1(text.encode()).hexdigest()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == [(i, len(text), expected) for i in range(3)]


def test_damage_is_seen():
    record = next(warc.records(1, "u", memoryview(b"payload"), hashlib.sha1(b"payload").hexdigest(), None, 100))
    assert len(list(warc.Parser().feed(record))) == 1
    with pytest.raises(ValueError, match="damaged"):
        list(warc.Parser().feed(record.replace(b"payload", b"paylode")))


def plain_neighbours(ids, x, is_query, k):
    out = {}
    norms = np.linalg.norm(x, axis=1)
    for i in np.flatnonzero(is_query):
        score = x @ x[i] / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]]
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def test_hadamard_is_orthogonal():
    eye = ann.hadamard(np.eye(16, dtype=np.float32))
    assert np.allclose(eye @ eye.T, np.eye(16), atol=1e-5)
    turned = ann.rotated(np.eye(8, dtype=np.float32), ann.signs(8, 1, 1)[0])
    assert np.allclose(turned @ turned.T, np.eye(8), atol=1e-5)


def test_cells_are_the_nearest_vertices():
    x = ann.padded(np.random.default_rng(1).normal(size=(20, 6)))
    turns = ann.signs(8, 2, 3)
    own, near = ann.cells(x, turns), ann.probed(x, turns, 12)
    first, second = (ann._sides(x, t) for t in turns)
    for i in range(len(x)):
        both = (first[i][:, None] + second[i][None, :]).ravel()
        assert own[i] == both.argmax() and set(near[i]) == set(np.argsort(-both)[:12])


def test_recall_on_hard_data(spark):
    """Vectors without structure, the hardest there are: few candidates, most of the nearest."""
    rng = np.random.default_rng(2)
    n, dims = 20_000, 64
    x = rng.normal(size=(n, dims)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float) / np.linalg.norm(x[r.query_id].astype(float)) / np.linalg.norm(x[r.vec_id].astype(float))), rel=1e-12)
    asked = np.arange(n) % 200 == 0
    plain = plain_neighbours(np.arange(n), x.astype(float), asked, 5)
    assert set(got) == set(plain) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(plain[q])) for q in plain) >= 0.9 * 5 * len(plain)
    unit, seen = ann.padded(x), np.zeros((int(asked.sum()), n), bool)
    for turns in ann.signs(dims, 2 * ann.TABLES, ann.SEED).reshape(ann.TABLES, 2, 3, -1):
        own = ann.cells(unit, turns)
        for i, near in enumerate(ann.probed(unit[asked], turns, ann.probes_for(n))):
            seen[i] |= np.isin(own, near)
    assert seen.mean() < 0.15


def test_results_do_not_depend_on_the_number_of_rows(spark):
    """Rows at right angles to all others change no answer, however many they are."""
    rng = np.random.default_rng(6)
    x = np.zeros((9600, 64), np.float32)
    x[:600, :32], x[600:, 32:] = rng.normal(size=(600, 32)), rng.normal(size=(9000, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 10 == 0
    few, many = (ann.neighbours(t, asked & (F.col("vec_id") < 600)).collect() for t in (df.where("vec_id < 600"), df))
    assert len(few) == 300 and sorted(few) == sorted(many)


@pytest.mark.parametrize("n", [500, 8000])
def test_probes_follow_the_neighbours_found(spark, n):
    """The same recall in small and larger tables, from the cells that the first tables' cosines ask for."""
    dims, first = 64, ann.first_tables(ann.TABLES)
    x = np.random.default_rng(7).normal(size=(n, dims))
    asked = np.arange(n) % (n // 100) == 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.neighbours(df, F.col("vec_id") % (n // 100) == 0).collect():
        got[r.query_id].add(r.vec_id)
    plain = plain_neighbours(np.arange(n), x, asked, 5)
    assert sum(len(got[q] & set(plain[q])) for q in plain) >= 0.9 * 5 * len(plain)
    unit, seen = ann.padded(x), np.zeros((int(asked.sum()), n), bool)
    turns = ann.signs(dims, 2 * ann.TABLES, ann.SEED).reshape(ann.TABLES, 2, 3, -1)
    own = [ann.cells(unit, t) for t in turns]
    for t in range(first):
        for i, near in enumerate(ann.probed(unit[asked], turns[t], ann.first_probes(dims))):
            seen[i] |= np.isin(own[t], near)
    length = np.linalg.norm(x, axis=1)
    cosine = np.where(seen, x[asked] @ x.T / np.outer(length[asked], length), -1.0)
    depth = ann.probes_for(np.sort(cosine, axis=1)[:, -6])
    for i, q in enumerate(np.flatnonzero(asked)):
        for t in range(first, ann.TABLES):
            seen[i] |= np.isin(own[t], ann.probed(unit[q : q + 1], turns[t], int(depth[i]))[0])
        # what the search returns is the best of these candidates, or of all rows
        best = sorted(np.flatnonzero(seen[i] & (np.arange(n) != q)), key=lambda j: -cosine_of(x, q, j))[:5]
        assert got[q] in (set(best), set(plain[q]))
    assert seen.mean() < {500: 0.7, 8000: 0.25}[n]


def cosine_of(x, i, j):
    return x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])


def _best(ids, x, asked, k):
    cell = np.zeros(len(x), np.int32)
    got = defaultdict(list)
    for who, own, score in zip(*ann.best(ids, x, cell, x[asked], np.arange(len(asked)), np.zeros(len(asked), np.int32), k)):
        got[int(ids[asked[who]])].append((int(own), float(score)))
    return got


def test_near_copies_are_ordered_in_double_precision():
    """Thousands of near copies, whose cosines single precision cannot tell apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + 1e-4 * rng.normal(size=(3000, 64))
    ids, asked = np.arange(3000), np.arange(0, 3000, 300)
    got = _best(ids, x, asked, 6)
    norms = np.linalg.norm(x, axis=1)
    for q in asked:
        score = x @ x[q] / (norms * norms[q])
        assert {j for j, _ in got[q]} - {q} == set([j for j in np.argsort(-score) if j != q][:5])


def test_parallel_vectors_tie_and_the_smaller_ids_win(spark):
    """More rows tie than any shortlist holds: the query's powers of two, in any order."""
    rng = np.random.default_rng(4)
    q = rng.normal(size=64)
    x = np.concatenate([[q * 2.0 ** (i % 60 - 30) for i in range(150)], rng.normal(size=(300, 64))])
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(450)
        ids = np.argsort(order)  # ids[j]: the id of row j
        asked = np.array([0])
        got = [j for j, _ in _best(ids, x, asked, 6)[int(ids[0])] if j != ids[0]][:5]
        assert got == sorted(i for i in ids[:150] if i != ids[0])[:5]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = ann.neighbours(df, F.col("vec_id") == int(ids[0])).orderBy("rank").collect()
    assert [r.vec_id for r in found] == got and all(r.score == pytest.approx(1.0, rel=1e-15) for r in found)


def test_extreme_components_and_full_blocks(spark, monkeypatch):
    rows = [(1, [1e300, 1e300, 0.0]), (2, [1e-300, 1e-300, 0.0]), (3, [1e308, 0.0, 0.0]), (4, [5e-324, 5e-324, 5e-324]), (4, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.neighbours(df, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in found] == [(2, 1.0), (4, 1.0), (3, round(0.5**0.5, 12))]
    # one direction holds nearly all rows, so its block is dealt over several groups
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((1200, 8)) + 1e-3 * rng.normal(size=(1200, 8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 300 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    plain = plain_neighbours(np.arange(1500), x, np.arange(1500) % 300 == 0, 5)
    assert sum(len(set(got[q]) & set(plain[q])) for q in plain) >= 0.9 * 5 * len(plain)
    assert all(set(got[q]) == set(plain[q]) for q in plain if q < 1200)


def test_ties_and_bad_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [2.0, 4.0, 6.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0, 1.0]), (None, same), (3, same), (107, [3.0, 1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "v": F.lit(1)})
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id").isin(0, 3, 39, 101, 103, 106, 107)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[39] == [0, 1, 2, 3, 4]
    assert set(got) == {0, 3, 39, 107}
    few = ann.neighbours(df.where("vec_id in (0, 107)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 107)]
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0
