"""SimHash near-duplicates and suffix dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpident.llm import jaccard, simhash, suffix_dedup

DOC = "doc_id long, text string, source string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=4):
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall((text or "").encode())]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=4):
    """fps: (id, fingerprint). The smallest id reachable, for each row."""
    x = np.array([f for _, f in fps], np.uint64)
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= max_bits):
            root[find(i)] = find(int(j))
    least = {}
    for i, (own, _) in enumerate(fps):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return [least.get(find(i)) for i in range(len(fps))]


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \n", "One two", "one TWO", "İ é É", "x " * 30_000]
    for _ in range(n):
        base = [word() for _ in range(rng.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice(["\n", " ", "\t"]).join(copy))
    return out


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = [(i, t, "s") for i, t in enumerate(texts(rng, 120))]
    rng.shuffle(rows)
    rows += [rows[0], rows[0], (None, rows[5][1], "s"), (None, "quite alone in this world of texts", "s")]
    docs = spark.createDataFrame(rows, DOC).withColumns({"fp": F.lit("x"), "component_id": F.lit("y"), "g": F.lit(1)})
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    fps = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == sorted((str(i), signed(f), str(c)) for (i, f), c in zip(fps, plain_components(fps)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for (i, _), c in zip(fps, plain_components(fps)) if i is None or i == c}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "part"), [(1, 1 << 16), (2, 8), (4, 1 << 16), (4, 8)])
def test_variants_find_every_link(spark, monkeypatch, bits, part):
    """Chains at the very limit, dense groups, and random fingerprints; buckets whole and in parts."""
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rng = random.Random(bits)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            fps.add(f)
            for b in rng.sample(range(64), bits):
                f ^= 1 << b
    fps |= {1 << b for b in range(64)} | {0}
    rows = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in rows], "fp long")
    found = {r.v: r.root for r in simhash.components(simhash.links(nodes, bits)).collect()}
    groups = {}
    for f, c in zip(rows, plain_components([(i, f) for i, f in enumerate(rows)], bits)):
        groups.setdefault(c, set()).add(f - (1 << 64) if f >> 63 else f)
    for own in groups.values():
        assert {found.get(f, f) for f in own} == {min(own)}


def test_spanning_connects_what_links_connect():
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 50, np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    edges = [(int(a), int(b)) for x, y in simhash.spanning(fps, 4) for a, b in zip(x, y)]
    comps = plain_components([(i, int(f)) for i, f in enumerate(fps)])
    assert len(edges) == len(fps) - len(set(comps))
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 4 for a, b in edges)


def test_keys_of_very_many_rows_are_dealt_over_tasks(spark, monkeypatch):
    from corpident.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    many = spark.range(100).select("id", F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 7).alias("key"))
    one = many.groupBy("key").agg(F.count("*").alias("copies"), F.max("id").alias("top"))
    plain = sorted(map(tuple, many.join(one.drop("copies"), "key").select("id", "key", "top").collect()))
    assert sorted(map(tuple, common.spread_join(many, one, "key", "copies", "id").select("id", "key", "top").collect())) == plain


def test_components_of_long_paths(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(500, 501), (501, 500), (7, 7)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(200)) and got[501] == 500


def plain_jaccard(rows, k=5):
    """rows: (id or None, text). The smallest id reachable over pairs of similarity 0.8 or more, for each row."""
    sets = []
    for _, t in rows:
        words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall((t or "").encode())]
        sets.append({b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return [least.get(find(i)) for i in range(len(rows))]


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 146, 3000):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2)).astype(np.uint64)]))
            apart = len(np.setxor1d(x, y))
            for bits in (512, 4096):
                p, q = (jaccard.parities(s, bits) for s in (x, y))
                assert np.bitwise_count(p ^ q).sum() <= apart
                # the sketch of more bits folds to that of fewer
                assert (np.bitwise_xor.reduce(jaccard.parities(x, 8 * bits).reshape(-1, bits // 8)) == p).all()
                if jaccard.similar(x, y, (4, 5)):
                    assert jaccard.may_be(p[None], q[None], np.array([len(x) + len(y)]), (4, 5)).all()


@pytest.mark.parametrize(("small", "sample", "part"), [(32, 10_000, 1 << 16), (2, 50, 8), (2, 1, 1 << 16)])
def test_similarity_against_brute_force(spark, monkeypatch, small, sample, part):
    """Edits around the limit, long shared passages, a dense group, and what has few words."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "PART_ROWS", part)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 40 * part)
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    found = texts(rng, 40)
    for n in (20, 60, 100, 300):
        for _ in range(8):
            base = [word() for _ in range(n)] + passage * rng.randint(0, 1)
            found.append(" ".join(base))
            for edits in (1, 2, 4, 7):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = word()
                found.append(" ".join(copy[: rng.randint(len(copy) * 9 // 10, len(copy))]))
    base = [word() for _ in range(200)]
    found += [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(50)]
    rows = list(enumerate(found))
    rng.shuffle(rows)
    rows += [rows[0], (None, rows[5][1]), (None, "quite alone in this world of texts")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOC).withColumns({"v": F.lit("x"), "component_id": F.lit("y"), "n": F.lit(1)})
    plain = plain_jaccard(rows)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs, shingle=5, similarity=(4, 5)).collect())
    assert got == sorted((str(i), str(c)) for (i, _), c in zip(rows, plain))
    if small == 32:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for (i, _), c in zip(rows, plain) if i is None or i == c}
        assert simhash.near_duplicates(docs.limit(0), shingle=5, similarity=(4, 5)).count() == 0


def plain_cut(rows, width=50):
    """rows: (id or None, text). Per row n_bytes, spans, kept."""
    last = 1 << 62
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), last if i is None else i
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b, i = (t or "").encode(), last if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passages(rng, n):
    word = lambda: "".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)] + ["te " * 60, "a" * 120, "ab" * 80]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))], word()]
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "group", "hot"), [(1, 4 << 20, 256), (2, 2000, 256), (3, 2000, 2), (4, 500, 3)])
def test_cut(spark, monkeypatch, seed, group, hot):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "N_RANGES", 3 if seed == 2 else 4096)
    if seed == 4:  # whatever the hash says, bytes decide
        monkeypatch.setattr(suffix_dedup, "_row_hash", lambda rows: np.zeros(len(rows), np.uint64))
    rng = random.Random(seed)
    rows = passages(rng, 90)
    rows += [(1000, None), (1001, ""), (1002, "x" * 49), (1003, "y" * 50), (1004, "y" * 50), (None, rows[3][1]), (None, "z" * 60), (5, rows[7][1]), rows[8], rows[8], (2000, rows[9][1])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], DOC).withColumns({"id": F.lit("x"), "kept": F.lit(1), "g": F.lit(2)})
    got = suffix_dedup.cut(docs, keep=("source", "g")).collect()
    assert len(got) == len(rows) and got[0].source == "s" and got[0].g == 2
    mine = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in got)
    assert mine == sorted((str(i), *x) for (i, _), x in zip(rows, plain_cut(rows)))


def test_cut_texts(spark):
    base = "é" * 60
    rows = [(1, base, "a"), (2, "x" + base + "y", "b"), (3, None, "c"), (4, "alone", None), (5, base, "e")]
    docs = spark.createDataFrame(rows, DOC).select("source", "text", "doc_id")
    got = {r.doc_id: (r.text, r.source) for r in suffix_dedup.cut_texts(docs).collect()}
    assert got == {1: (base, "a"), 2: ("xy", "b"), 3: (None, "c"), 4: ("alone", None), 5: ("", "e")}
    assert suffix_dedup.cut_texts(docs).columns == docs.columns
    assert suffix_dedup.cut(docs.limit(0)).count() == 0 and suffix_dedup.cut_texts(docs.limit(0)).count() == 0
    # a span that begins or ends inside a character leaves that character whole
    assert suffix_dedup.text_without("aéb".encode(), [(0, 2)]) == "éb" and suffix_dedup.text_without("aéb".encode(), [(2, 4)]) == "aé"


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, (20_000, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words)
    assert sorted(order.tolist()) == list(range(len(words)))
    ranked = [tuple(r) for r in words[order]]
    assert ranked == sorted(ranked)
