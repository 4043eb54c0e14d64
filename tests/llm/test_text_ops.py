"""Quality rules, classifier, token counts, mixing and packing against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpident.llm import mixing, packing, quality_classifier, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string"


def odd_texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    loop = " ".join("one two three four five six seven eight nine".split() * 4)
    return [None, "", " \t\n", "word", "a  b\tc\n\na  b\tc\n", loop, "# * $ | <x>\n" * 9, "x" * 50_000, " nb sp em", "line\r\nline\r\nline\r\n", *[" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(20)], "te " * 400]


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for own in places.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def docs_of(spark, texts, sources=("a",)):
    return spark.createDataFrame([(i, t, sources[i % len(sources)]) for i, t in enumerate(texts)], DOC)


def test_rules(spark):
    texts = odd_texts(random.Random(1))
    # columns that clash with those the operator makes
    rows = docs_of(spark, texts).withColumns({"n_words": F.lit("x"), "m": F.lit(1), "kept": F.lit(2)})
    got = {r.doc_id: r for r in quality_rules.judge(rows, keep=("source",)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, m = got[i], plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, t and t[:50]
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and r.source == "a"
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(rows.limit(0)).count() == 0
    twice = rows.union(rows)
    assert quality_rules.judge(twice).groupBy("doc_id").count().where("count = 2").count() == len(texts)


def test_rule_order_does_not_change_verdicts(spark):
    rows = docs_of(spark, odd_texts(random.Random(2)))
    rules = quality_rules.default_rules()
    first = {r.doc_id: r.kept for r in quality_rules.judge(rows, rules=rules).collect()}
    assert first == {r.doc_id: r.kept for r in quality_rules.judge(rows, rules=rules[::-1]).collect()}


def test_rule_order_is_measured_and_stable(spark):
    """A dear rule that rejects little goes last, one that an earlier rule makes idle goes
    behind it, and the order does not change from run to run."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts = [" ".join([*(word() for _ in range(60)), "#" * (i % 2), "!" * (i % 10 == 3)]) for i in range(300)]
    rows = docs_of(spark, texts).select("text")
    hash_, mark = F.contains("text", F.lit("#")), F.contains("text", F.lit("!"))
    rules = [
        quality_rules.Rule("dear", sum(F.regexp_count("text", F.lit(rf"\p{{L}}+{c}\b")) for c in "abcdefgh") < 0),
        quality_rules.Rule("again", hash_ & F.lit(True)),
        quality_rules.Rule("cheap", hash_),
        quality_rules.Rule("few", mark),
    ]
    orders = [[(r.name, round(rate, 2)) for r, _, rate in quality_rules.order_rules(rows, rules)] for _ in range(3)]
    names = [[n for n, _ in o] for o in orders]
    assert all(set(o[:1]) <= {"cheap", "again"} and o[-1] in ("dear", "cheap", "again") for o in names)
    assert all(o.index("few") < o.index("dear") for o in names)
    first = dict(orders[0])
    assert sorted((first["cheap"], first["again"])) == [0.0, 0.5]


def test_rejected_samples_give_the_order_as_given(spark):
    rules = quality_rules.default_rules()
    rows = docs_of(spark, ["few words", None, ""]).select("text")
    assert [r.name for r, _, _ in quality_rules.order_rules(rows, rules)] == [r.name for r in rules]
    with pytest.raises(ValueError, match="kept"):
        quality_rules.judge(docs_of(spark, ["a"]).withColumn("kept", F.lit(1)), keep=("kept",))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality_classifier.fit(x[:2000], y[:2000])
    score = model.scores(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.95 and score.min() >= 0 and score.max() <= 1

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.child[at] + (row[model.feature[at]] > model.cut[at])
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [walk(r) for r in x[2000:2050]])
    for labels in ([], [1.0], [0.0, 0.0]):
        own = quality_classifier.fit(np.zeros((len(labels), 5)), np.array(labels))
        assert np.allclose(own.scores(np.zeros((2, 5))), (sum(labels) + 1) / (len(labels) + 2))


def test_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(20, 80))).capitalize() + "."
    bad = lambda: " ".join(word() + rng.choice(["###", "%%%", "&&&"]) for _ in range(rng.randint(20, 80)))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(600)]
    docs = spark.createDataFrame([*rows, (600, None, "s"), (601, "", None), (None, good(), "s"), (0, rows[0][1], "s")], DOC).withColumns({"score": F.lit("x"), "c0": F.lit("y")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model, keep=("source",)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held) > 0.95 * len(held)
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.5}
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_held_out_rows_teach_nothing(spark):
    import zlib

    ids = range(200)
    out = {r.i for r in spark.range(200).withColumnRenamed("id", "i").where(quality_classifier.held_out(F.col("i"))).collect()}
    assert out == {i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1}
    docs = spark.createDataFrame([(i, "a b c", "s") for i in ids], DOC)
    labels = spark.createDataFrame([(i, 0 if i in out else 1) for i in ids], "doc_id long, quality int")
    assert quality_classifier.train(docs, labels).scores(np.zeros((1, 17)))[0] > 0.99


@pytest.fixture(scope="module")
def count():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.counter(f.read())


PIECES = ["word", " ", "  ", "\n", " don't", "é", "\u00a0", "123", "!?", "\t", "'s", "\x1c", "漢字の魔法を裏覚醒する", "日本", " a", " the", "'", "é\u0301", "Ωδ", "x1", "'re", "٣", "\u2028", "'sé", "한국어"]


def test_leaves_keep_tokens(count):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 300)))
        for size in (1, 16):
            parts, known = count.measured(text, size)
            assert "".join(parts) == text
            assert tuple(known.sum(axis=0)) == (len(text), *count(text))
            assert [count(p)[0] for p in parts] == known[:, 1].tolist()


def test_edits_equal_encoding_anew(count):
    rng = random.Random(6)
    for round_ in range(160):
        pieces = PIECES if round_ % 2 else ["word", " ", "  ", "\n", " don't", "é", "123", "!?", " a", " the", " longer"]
        make = lambda n: "".join(rng.choice(pieces) for _ in range(n))
        text = make(rng.randint(0, 900))
        tree = token_counts.SegmentTree(text, count)
        for _ in range(12):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 5, 60, 2000])
            new = make(rng.choice([0, 0, 1, 3, 40, 700]))
            tree.replace(a, b, new)
            start = min(a, len(text))
            text = text[:start] + new + text[max(start, min(b, len(text))) :]
            assert "".join(tree.parts) == text
            assert tree.total == (len(text), *count(text))


@pytest.mark.parametrize("text", [" ".join(f"word{i}" for i in range(20000)), "漢字かな交じり文は長く続く、" * 1500, "漢字文長続日本語学校" * 2000])
def test_edits_encode_little(count, text):
    tree = token_counts.SegmentTree(text, count)
    for place in (0, 7000, 7011, 15_003):
        tree.encoded = 0
        tree.replace(place, place + 3, "xyz")
        assert 0 < tree.encoded < 100


def test_token_counts(spark, count):
    texts = odd_texts(random.Random(7))
    edits = F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(3).cast("long").alias("stop"), F.lit(" new ").alias("text")), F.lit(None), F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("text"))))
    rows = docs_of(spark, texts).withColumn("n_tokens", F.lit("x"))
    rows = rows.union(rows.limit(1))
    got = token_counts.count_tokens(rows, edits=edits).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n_chars, r.n_tokens, r.n_pretokens) == (len(text), *count(text))
        if r.doc_id % 4 == 0:
            text = text[: min(1, len(text))] + " new " + text[3:]
        assert (r.n_chars_edited, r.n_tokens_edited, r.n_pretokens_edited) == (len(text), *count(text))
    assert token_counts.count_tokens(rows.limit(0)).count() == 0


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        shares = sum(w[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and shares and w[s] * left / shares > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in stopped else w[s] * left / shares for s in names}
        left -= sum(2 * sizes[s] for s in over)
        stopped |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "é", None, "ｚ"])) for i in range(900)]
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "x y", "a"), (5, *rows[5][1:]), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, DOC).withColumns({"n": F.lit("x"), "target": F.lit(1), "_part": F.lit(2)})
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goals, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 400, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    # no name of the caller's may clash with one of the operator's
    odd = ("row", "id", "key", "n", "times", "copy", "_row", "_times", "_copy", "_id", "_r", "_sum", "_rows", "each", "rest", "rows", "taken", "hash", "a.b", "_s", "_parts")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("source")) for c in odd})
    mix = mixing.take(docs)
    assert mix.columns == docs.columns
    rows_of = lambda df: Counter(map(str, df.collect()))
    assert set(rows_of(mix)) <= set(rows_of(docs))
    for c in ("size", "doc_id"):
        with pytest.raises(ValueError, match=c):
            mixing.plan(docs.withColumn("size", F.lit(1)), keep=(c,))
    times = Counter(r.doc_id for r in mix.collect())
    wanted = Counter()
    for r in got:
        wanted[r.doc_id] += r.copies
    assert times == +wanted
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


def plain_padding(histogram, ends):
    total, at = 0, 0
    for length, n in sorted(histogram):
        while ends[at] < length:
            at += 1
        total += (ends[at] - length) * n
    return total


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(150):
        lengths = rng.sample(range(1, 60), rng.randint(1, 9))
        histogram = [(x, rng.randint(1, 20)) for x in lengths]
        k = rng.randint(1, 5)
        ends = packing.boundaries(histogram, k)
        top = max(lengths)
        best = min(plain_padding(histogram, sorted({*c, top})) for n in range(min(k, len(lengths))) for c in combinations(lengths, n))
        assert len(ends) <= k and ends[-1] == top and plain_padding(histogram, ends) == best
    assert packing.boundaries([], 3) == []


def test_packing(spark, count):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 7, 7, 7, 30, 130])), "s") for i in range(400)] + [(400, None, "s"), (None, "a b", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (401, "漢字 é " * 50, "s")]
    docs = spark.createDataFrame(rows, DOC).withColumns({"length": F.lit("x"), "batch": F.lit(1), "tokens": F.lit(2)})
    got = packing.pack(docs, max_len=50, budget=200, n_buckets=3, keep=("source",)).collect()
    wanted = Counter()
    for i, t, _ in rows:
        own = count.encode(t or "")
        wanted.update((i, a // 50, tuple(own[a : a + 50])) for a in range(0, len(own), 50))
    assert Counter((r.doc_id, r.piece, tuple(r.tokens)) for r in got) == wanted
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
        assert r.start == 50 * r.piece and r.length == len(r.tokens) <= r.padded <= 50
    for own in batches.values():
        room = 200 // own[0].padded
        assert len(own) * own[0].padded <= 200 and sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
    for b in {k[0] for k in batches}:
        full = sorted(k[1] for k in batches if k[0] == b)
        assert full == list(range(len(full)))
        assert all(len(batches[b, n]) == 200 // batches[b, n][0].padded for n in full[:-1])
        of = [r.length for n in full for r in sorted(batches[b, n], key=lambda r: r.slot)]
        assert of == sorted(of)
    histogram = list(Counter(r.length for r in got).items())
    assert sorted({r.padded for r in got}) == packing.boundaries(histogram, 3)
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="tokens"):
        packing.pack(docs, keep=("tokens",))
