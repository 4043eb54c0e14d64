"""The similarity of sets of word shingles, exactly: what simhash.py verifies links by, and
how it finds the links that fingerprints do not show.

Two sets are similar if they share at least the stated fraction of their union. Sets that
similar share one of the first n - ceil(fraction n) + 1 shingles of each, in any order that is
the same for all sets (prefix filter). The order is by how often a bounded sample of documents
holds a shingle, then by hash, so common passages stay out of the prefixes; the sample decides
the cost, never the result. Documents of equal sets are one node. A 64-bit hash stands for a
shingle and for a set; nothing else is approximate.

stars() pairs the nodes of a prefix shingle with a few of them, which connects most groups of
copies; across() then pairs all nodes of a shingle that are not connected yet, so a group of
copies never lists all its pairs. Pairs are compared on their whole sets, those that hang
together in one place; what is too much for one place is dealt over several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, partitions, shingle_hashes, stash, unstash
from .stars import components

#: Documents whose shingles are counted for the order, about, and counts kept, at most.
SAMPLE, HOT = 10_000, 1 << 17
#: Buckets of up to this many members are compared by shifting, larger ones row by row.
SMALL = 32
#: Prefix rows of a group of buckets, members of one part of a bucket, and shingles of a group of comparisons, about.
GROUP_ROWS, PART_ROWS, GROUP_SHINGLES = 1 << 19, 1 << 16, 1 << 21
#: Nodes of a bucket that the others are first paired with.
CENTRES = 4
#: Bits of a coarse sketch of a set, and of a fine one at most.
COARSE, MOST_BITS = 512, 1 << 16
#: Pairs that a group of buckets collects before it drops repeated ones.
PENDING = 1 << 21
#: Pairs whose sketches are compared at a time.
BLOCK = 1 << 15


def bits(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.astype("<u8").tobytes(), 42)


def prefix(own: np.ndarray, hot: np.ndarray, counts: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The shingles of which similar sets share one; hot: hashes in order, with their counts."""
    n, (num, den) = len(own), similarity
    if not n:
        return own
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        own = own[np.argsort(np.where(hot[at] == own, counts[at], 0), kind="stable")]
    return own[: n - -(-num * n // den) + 1]


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of a sample hold, in order, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["key"])

    n = texts.count()
    some = texts.sample(min(1.0, SAMPLE / max(1, n)), 42) if n > SAMPLE else texts
    found = some.mapInArrow(run, "key long").groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(HOT).toArrow()
    hot, counts = found.column("key").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(hot)
    return hot[order], counts[order]


def sketches(texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """texts: id, text, h. One row per document: id long, h, v long (the set's hash, signed), n
    int (its size), fp long, prefix, and the parity sketches coarse (of COARSE bits) and fine (of about 6 n, or COARSE)."""
    hot, counts = common_shingles(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n, fp, firsts, coarse, fine = [], [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                own = np.unique(hashes)
                v.append(digest(own))
                n.append(len(own))
                fp.append(bits(hashes))
                firsts.append(prefix(own, hot, counts, similarity).view(np.int64))
                coarse.append(parities(own, COARSE).tobytes())
                fine.append(parities(own, min(MOST_BITS, max(COARSE, 1 << (4 * len(own)).bit_length()))).tobytes())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (v, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), signed[0], pa.array(n, pa.int32()), signed[1], pa.array(firsts, pa.list_(pa.int64())), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), batch.column(2)], ["id", "v", "n", "fp", "prefix", "coarse", "fine", "h"])

    return texts.mapInArrow(run, "id long, v long, n int, fp long, prefix array<long>, coarse binary, fine binary, h long")


def parities(own: np.ndarray, bits: int) -> np.ndarray:
    """For each value of the low bits of a hash, whether an odd number of the hashes has it.
    Each element that only one of two sets holds flips one bit, so they differ in at least as
    many elements as their sketches do in bits."""
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1)


def may_be(x: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether rows of sketches leave room for the similarity; n: the sizes of both sets together."""
    num, den = similarity
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (num + den) * apart <= (den - num) * n


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b, w) whose fine sketches leave room for the similarity."""

    def fold(sketch: bytes, size: int) -> np.ndarray:
        # the sketch of fewer bits: hashes that agree in those share a bit
        return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        for batch in batches:
            keep = []
            for w, x, y in zip(batch.column("w").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64))
                keep.append((num + den) * apart <= (den - num) * w)
            yield batch.select(["a", "b", "w"]).filter(pa.array(keep, pa.bool_()))

    own = nodes.select("v", "fine")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "w", "x", "y")
    return both.mapInArrow(run, "a long, b long, w long")


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """nodes: v, n, prefix. One row (key, at, v, n, m) per prefix shingle that m > 1 nodes have."""
    rows = nodes.select("v", "n", F.posexplode("prefix").alias("at", "key"))
    return rows.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")


class Pairs:
    """Rows (a, b, w): pairs of nodes that may be similar, and how many shingles both have."""

    def __init__(self, at: np.ndarray, v: np.ndarray, n: np.ndarray, similarity: tuple[int, int], coarse: np.ndarray | None = None):
        self.at, self.v, self.n, (self.num, self.den), self.coarse = at, v, n, similarity, coarse
        self.found, self.pending = [np.zeros((0, 3), np.int64)], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        # at a shingle they share first, no more than the rest of the shorter list can follow
        n, at, v = self.n, self.at, self.v
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        fits = (self.num + self.den) * most >= self.num * (n[i] + n[j])
        i, j = i[fits], j[fits]
        if self.coarse is not None:
            room = [may_be(self.coarse[i[k : k + BLOCK]], self.coarse[j[k : k + BLOCK]], n[i[k : k + BLOCK]] + n[j[k : k + BLOCK]], (self.num, self.den)) for k in range(0, len(i), BLOCK)]
            room = np.concatenate([np.zeros(0, bool), *room])
            i, j = i[room], j[room]
        self.found.append(np.stack([np.minimum(v[i], v[j]), np.maximum(v[i], v[j]), n[i] + n[j]], axis=1))
        self.pending += len(i)
        if self.pending > PENDING:
            self.found, self.pending = [np.unique(np.concatenate(self.found), axis=0)], 0

    def table(self) -> pa.Table:
        rows = np.unique(np.concatenate(self.found), axis=0)
        return pa.table({c: pa.array(rows[:, i]) for i, c in enumerate("abw")})


def _groups(shared: DataFrame) -> int:
    return max(partitions(shared.sparkSession), -(-shared.count() // GROUP_ROWS))


def stars(shared: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, w) of each node with the first few, by hash, of those that share a prefix shingle."""
    rows = dealt(shared, "key", "v", F.ceil(F.col("m") / PART_ROWS), _groups(shared)).select("g", "key", "lo", "hi", "at", "v", "n")

    def run(table: pa.Table) -> pa.Table:
        key, lo, hi, at, v, n = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "at", "v", "n"))
        order, first, size = _by_bucket(np.lexsort((v, hi, lo, key)), key, lo, hi)
        pairs = Pairs(at[order].astype(np.int64), v[order], n[order].astype(np.int64), similarity)
        nth = np.arange(len(order)) - np.repeat(first, size)
        for k in range(CENTRES):
            j = np.flatnonzero(nth > k)
            pairs.add(j - nth[j] + k, j)
        return pairs.table()

    return rows.groupBy("g").applyInArrow(run, "a long, b long, w long").distinct()


def _by_bucket(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, and where its runs of equal keys start and how long they are."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def bucket_pairs(pairs: Pairs, label: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
    """Adds the pairs of each bucket whose labels differ. Rows of a bucket come in order of n."""
    run = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, len(label))):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[:-d] & (label[d:] != label[:-d]))
        pairs.add(i, i + d)
    for s, m in zip(first[size > SMALL], size[size > SMALL]):
        own, n = label[s : s + m], pairs.n[s : s + m]
        names, which, count = np.unique(own, return_inverse=True, return_counts=True)
        # all but those of the most common label look at the whole bucket, at each other once
        few = which.ravel() != count.argmax()
        low = np.searchsorted(n, -(-n * pairs.num // pairs.den), "left")
        high = np.searchsorted(n, n * pairs.den // pairs.num, "right")
        for i in np.flatnonzero(few):
            j = np.arange(low[i], high[i])
            j = j[(own[j] != own[i]) & (~few[j] | (j > i))]
            pairs.add(np.full(len(j), s + i), s + j)


def across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs (a, b, w) that share a prefix shingle, may be similar, and have different
    labels. labels: v, label, for nodes that are connected to others. Sketches rule most
    pairs out where they are met, before any is written."""
    own = nodes.select("v", "coarse").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    rows = dealt(shared.join(own, "v"), "key", "v", F.ceil(F.col("m") / PART_ROWS), _groups(shared)).select("g", "key", "lo", "hi", "at", "v", "n", "label", "coarse")

    def run(table: pa.Table) -> pa.Table:
        key, lo, hi, at, v, n, label = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "at", "v", "n", "label"))
        order, first, size = _by_bucket(np.lexsort((v, n, hi, lo, key)), key, lo, hi)
        coarse = np.frombuffer(b"".join(table.column("coarse").to_pylist()), np.uint8).reshape(-1, COARSE // 8).view(np.uint64)
        pairs = Pairs(at[order].astype(np.int64), v[order], n[order].astype(np.int64), similarity, coarse[order])
        bucket_pairs(pairs, label[order], first, size)
        return pairs.table()

    return rows.groupBy("g").applyInArrow(run, "a long, b long, w long").distinct()


def similar(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> bool:
    num, den = similarity
    return (num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y))


def whole_sets(texts: DataFrame, nodes: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(v, own) for the nodes asked for, from one document of each, or more of equal id."""
    ids = stash(nodes.join(asked, "v", "left_semi").select(F.col("least_id").alias("_id")).distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            v = np.fromiter((digest(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["v", "own"])

    return texts.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(run, "v long, own array<long>")


def links(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that connect what the similar ones of the pairs (a, b, w) connect.

    Pairs that hang together are compared in one place, so a set goes there once; what is too
    much for one place is dealt over several by the pairs' first nodes."""
    together = components(pairs.select("a", "b")).select(F.col("v").alias("a"), "root")
    rooted = stash(pairs.join(together, "a", "left").withColumn("root", F.coalesce("root", "a")), "rooted")
    total = rooted.agg(F.sum("w")).first()[0] or 0
    groups = max(partitions(pairs.sparkSession), -(-total // GROUP_SHINGLES))
    large = rooted.groupBy("root").agg(F.sum("w").alias("w")).where(F.col("w") > GROUP_SHINGLES)
    large = stash(large.select("root", F.ceil(F.col("w") / GROUP_SHINGLES).alias("parts")), "large")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))
    cells = stash(rooted.join(large, "root", "left").select(F.pmod(F.xxhash64(F.col("root"), part), F.lit(groups)).alias("g"), "a", "b"), "cells")
    ends = stash(cells.select(F.explode(F.array("a", "b")).alias("v"), F.col("g").alias("h")).distinct(), "ends")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of = {v: s.values.to_numpy().view(np.uint64) for v, s in zip(right.column("v").to_pylist(), right.column("own"))}
        root, out = {}, []

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = root[v]
            return v

        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y and similar(of[a], of[b], similarity):
                root[x] = y
                out.append((a, b))
        return pa.table({c: pa.array([e[i] for e in out], pa.int64()) for i, c in enumerate("ab")})

    sets = whole_sets(texts, nodes, ends.select("v").distinct(), shingle)
    done = stash(cells.groupBy("g").cogroup(sets.join(ends, "v").groupBy("h")).applyInArrow(run, "a long, b long"), "edges")
    unstash(rooted, large, cells, ends)
    return done
