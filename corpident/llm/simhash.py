"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most
four bits have a segment in which they differ in at most one (three segments of two or more
would need six), so after wiping the right bit of that segment they agree on it. Each
distinct fingerprint is indexed under its 64 one-wildcard segment variants, variants are
equality-grouped, members are verified on all 64 bits, and a spanning forest of the links
goes on to connected components. Only spanning edges leave a bucket, never all its pairs,
and each pair is either compared or already known to be connected. A variant that very many
fingerprints share is dealt into parts, and each pair of parts is compared in a group of its own.

With similarity, documents are linked by the similarity of their sets of shingles instead of
by bits. Links of fingerprints are then candidates that are verified on the sets: they find
most copies at a cost that grows with the documents. Similar sets whose fingerprints lie
further apart are found exactly, by the prefix filter of jaccard.py, among what is not yet
connected. No link is lost to the bits.

Nulls and edge cases: a null or wordless text has fingerprint zero (with similarity: the empty
set) and links like any other; fewer words than a shingle make one shingle of them all;
repeated rows stay and get equal results; rows with a null id take part, their component is
the smallest id reachable (null if there is none); an empty table gives an empty result;
other columns are ignored by near_duplicates and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import dealt, partitions, runs, shingle_hashes, spread_join, stash, unstash
from .stars import as_nodes, components

#: Segments as (lowest bit, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of up to this many members are compared by shifting, larger ones by search.
SMALL = 16
#: Variant rows that one group of buckets holds, and members of one part of a bucket, about.
GROUP_ROWS, PART_ROWS = 1 << 19, 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    return jaccard.bits(shingle_hashes(text, shingle))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("binary")).alias("h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: id long, fp long (the bits, signed), h long (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["id", "fp", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col))
    return rows.mapInArrow(run, "id long, fp long, h long")


def spanning(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest over all links among distinct fingerprints. Each member
    reached is compared with those not reached yet, so a dense group costs about its size."""
    rest, out = np.arange(len(fps)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[i]) <= max_bits
            if near.any():
                hit = rest[near]
                out.append((np.full(len(hit), i), hit))
                todo += hit.tolist()
                rest = rest[~near]
    return out


def bucket_links(keys: tuple[np.ndarray, ...], fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Rows (fp, fp) that connect, within each key, whatever that key's links connect."""
    order, first, size = runs(*keys)
    fp = fp[order]
    run = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= SMALL, size)
    found = [np.zeros((0, 2), np.uint64)]
    for d in range(1, min(SMALL, len(fp))):
        i = np.flatnonzero((run[d:] == run[:-d]) & small[:-d])
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        found.append(np.stack([fp[i], fp[i + d]], axis=1))
    for s, n in zip(first[size > SMALL], size[size > SMALL]):
        found += [np.stack([fp[s + x], fp[s + y]], axis=1) for x, y in spanning(fp[s : s + n], max_bits)]
    return np.unique(np.concatenate(found), axis=0).view(np.int64)


def _segment(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _variants(part: Column, low: int, width: int) -> list[Column]:
    return [F.lit((low + i) << 32).bitwiseOR(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)))) for i in range(width)]


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """nodes: fp long, distinct. Edges (a, b) between fingerprints; their components are those of all links."""
    if max_bits > 2 * len(SEGMENTS) - 1:
        raise ValueError("three segments cover at most five differing bits")
    # a variant joins two values of a segment, so one of very many rows has a value of half as many
    per = nodes.select(F.explode(F.array(*[F.struct(F.lit(low).alias("low"), _segment(low, width).alias("part")) for low, width in SEGMENTS])).alias("x")).groupBy("x").count()
    per = per.where(F.col("count") > PART_ROWS // 2).select("x.low", "x.part", "count")
    keys = F.array().cast("array<bigint>")
    for low, width in SEGMENTS:
        keys = F.when(F.col("low") == low, F.array(*_variants(F.col("part"), low, width))).otherwise(keys)
    hot = stash(per.select(F.explode(keys).alias("key"), "count").groupBy("key").agg((F.ceil(F.sum("count") / PART_ROWS) + 1).alias("parts")), "hot")
    groups = max(partitions(nodes.sparkSession), -(-64 * nodes.count() // GROUP_ROWS))
    rows = nodes.select("fp", F.explode(F.array(*[v for low, width in SEGMENTS for v in _variants(_segment(low, width), low, width)])).alias("key"))
    rows = dealt(rows.join(hot, "key", "left"), "key", "fp", F.coalesce("parts", F.lit(1)), groups).select("g", "key", "lo", "hi", "fp")

    def run(table: pa.Table) -> pa.Table:
        keys = tuple(table.column(c).to_numpy() for c in ("key", "lo", "hi"))
        pairs = bucket_links(keys, table.column("fp").to_numpy().view(np.uint64), max_bits)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.groupBy("g").applyInArrow(run, "a long, b long").distinct()


def _rooted(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, component_id, copies."""
    found = found.select(F.col("v.key").alias(key), F.col("root.id").alias("_id"), F.lit(True).alias("_linked"))
    return nodes.join(found, key, "left").select(key, F.when(F.col("_linked"), F.col("_id")).otherwise(F.col("least_id")).alias("component_id"), "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, similarity: tuple[int, int] | None = None, text_hash: bool = False) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest id linked to it, directly
    or not), with text_hash also text_hash long, which tells texts of one id apart. Links are fingerprints of at most max_bits differing bits or, with similarity (a
    fraction), sets of shingles that similar."""
    if similarity is not None:
        return _result(_similar(docs, id_col, text_col, shingle, max_bits, similarity), text_hash)
    fps = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stash(fps.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")), "nodes")
    edges = stash(links(nodes.select("fp"), max_bits), "links")
    table = stash(_rooted(nodes, components(as_nodes(edges, nodes, "fp")), "fp"), "components")
    unstash(nodes, edges)
    return _result(spread_join(fps, table, "fp", "copies", "id"), text_hash)


def _result(found: DataFrame, text_hash: bool) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "fp", "component_id", *[F.col("h").alias("text_hash")] * text_hash)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, similarity: tuple[int, int]) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = stash(jaccard.sketches(texts.withColumn("h", _text_hash("text")), shingle, similarity), "sketches")
    nodes = stash(rows.groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("coarse").alias("coarse"), F.first("fine").alias("fine")), "nodes")
    rows = rows.select("id", "v", "fp", "h")
    # by fingerprint: one set stands for all of its fingerprint, and fingerprints are linked
    heads = stash(nodes.groupBy("fp").agg(F.min(F.struct("v", "n")).alias("head")).select("fp", "head.v", "head.n"), "heads")
    near = stash(links(heads.select("fp"), max_bits), "links")
    same = nodes.select("fp", F.col("v").alias("b"), F.col("n").alias("m")).join(heads, "fp").select(F.col("v").alias("a"), "b", F.col("n") + F.col("m"))
    other = heads.select(F.col("fp").alias("b"), F.col("v").alias("y"), F.col("n").alias("m"))
    linked = near.join(heads.withColumnRenamed("fp", "a"), "a").join(other, "b").select(F.col("v").alias("a"), F.col("y").alias("b"), F.col("n") + F.col("m"))
    shared = stash(jaccard.shared_prefixes(nodes), "shared")
    first = stash(same.union(linked).toDF("a", "b", "w").where("a <> b").union(jaccard.stars(shared, similarity)).distinct(), "pairs")
    first = stash(jaccard.plausible(first, nodes, similarity), "plausible")
    edges = jaccard.links(first, texts, nodes, shingle, similarity)
    labels = components(as_nodes(edges, nodes, "v")).select(F.col("v.key").alias("v"), F.col("root.key").alias("label"))
    second = stash(jaccard.across(shared, labels, nodes, similarity), "pairs")
    second = stash(jaccard.plausible(second, nodes, similarity), "plausible")
    more = jaccard.links(second, texts, nodes, shingle, similarity)
    table = stash(_rooted(nodes, components(as_nodes(edges.union(more), nodes, "v")), "v"), "components")
    unstash(nodes, heads, near, shared, first, second, edges, more)
    return spread_join(rows, table, "v", "copies", "id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The documents without those near a document of smaller id in their component. Rows with
    a null id stay; repeated rows of a document that stays do too. Rows of one id but different
    texts are judged each by its own text."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits, similarity, text_hash=True)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = stash(gone, "gone")  # its size is known then, and texts need not move if it is small
    same = (docs[id_col] == gone["_gone"]) & (F.xxhash64(docs[text_col].cast("binary")) == gone["_hash"])
    return docs.join(gone, same, "left_anti")
