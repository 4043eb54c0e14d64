"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard
transform) and assigned to the nearest signed axis, the vertex of the cross-polytope. A cell
of a table is the pair of vertices of two rotations, so a table has (2 d)^2 cells. Every row
is indexed under its cell in each of `tables` tables; a query looks into the cells of a table
whose two axes it is nearest to. How many follows from what it finds: in the first two
sevenths of the tables each query probes alike, and the cosine of its k-th nearest so far tells
how many cells of each other table find a row that near with the chance AIM (depths). A
nearer row falls into the probed cells more often, so a query with close neighbours needs few
cells and one with distant neighbours many. Rows and queries meet by equality of cells:
runs of neighbouring cells make a block of about BLOCK_ROWS rows, a row goes to one block a table, a
query only to the blocks that hold cells it probes, and blocks that are too full are dealt
over several groups. In a block a query is compared with the rows of its own cells alone, by
exact cosine in double precision, and keeps its k + 1 best; the best of those are the answer.
All rows are indexed; nothing is capped. Blocks follow the number of rows and move data only:
which rows are candidates depends on tables, seed and the query's own neighbours, or probes
where given, never on how many rows there are.

Equal vectors are searched for once, and of equal vectors the k + 1 smallest ids are indexed:
k answers, or the query itself and k more. A query that finds fewer than k + 1 rows, or only
rows so far off that the other tables would take as many cells as a table has, is compared
with all rows instead, in blocks.

Nulls and edge cases: vectors that are null, zero, of another length than most, or that hold
a null or non-finite component take no part, neither as query nor as candidate; nor do rows
with a null id. A row is no candidate of a query of its own id; repeated rows (same id and
vector) count once, and of rows of one id that differ the nearest counts; equal scores go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty
result; other columns are ignored. Vectors are scaled by a power of two before they are
multiplied, so no norm runs over or under.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unstash

TABLES, SEED = 14, 7
#: Cells probed in each of the first tables: one in PROBE_SHARE of all, up to PROBES. In the others, at least so many.
PROBE_SHARE, PROBES, LEAST_PROBES = 256, 64, 16
#: The chance to find the k-th nearest; steps of the cosine from 0 to 1; pairs drawn to measure.
AIM, STEPS, DRAWN = 0.9, 50, 1024
#: Rows of a block, and queries of a block of a whole search, about.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Pairs scored at a time, about.
PAIRS = 1 << 17
FOUND = "q long, h long, vec_id long, score double"


def signs(dims: int, rotations: int, seed: int) -> np.ndarray:
    """Random signs: a rotation, a round, a dimension."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (rotations, 3, dims)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; as many columns as a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def rotated(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """unit: rows of a power of two of columns; turn: signs of one rotation."""
    for s in turn:
        unit = hadamard(unit * s)
    return unit


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component into [0.5, 1)."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def padded(x: np.ndarray) -> np.ndarray:
    """Unit rows, with zeros up to a power of two of columns."""
    x = scaled(x)
    dims = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), dims), np.float32)
    out[:, : x.shape[1]] = x / length(x)[:, None]
    return out


def n_cells(dims: int) -> int:
    return (2 << max(0, dims - 1).bit_length()) ** 2


def _sides(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """How near each row is to each vertex: the axes, then their negatives."""
    x = rotated(unit, turn)
    return np.concatenate([x, -x], axis=1)


def cells(unit: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The cell of each row; turns: signs of the table's two rotations."""
    first, second = (_sides(unit, t) for t in turns)
    return (first.argmax(axis=1) * first.shape[1] + second.argmax(axis=1)).astype(np.int32)


def probed(unit: np.ndarray, turns: np.ndarray, n: int) -> np.ndarray:
    """The n cells each row is nearest to, by the sum of its two coordinates, in ascending order."""
    first, second = (_sides(unit, t) for t in turns)
    n = min(n, first.shape[1] ** 2)
    out = np.empty((len(unit), n), np.int32)
    some = max(1, (1 << 22) // first.shape[1] ** 2)
    for i in range(0, len(unit), some):
        both = (first[i : i + some, :, None] + second[i : i + some, None, :]).reshape(len(first[i : i + some]), -1)
        out[i : i + some] = np.argpartition(-both, n - 1, axis=1)[:, :n]
    return np.sort(out, axis=1)


def first_tables(tables: int) -> int:
    return max(1, tables * 2 // 7)


def first_probes(dims: int) -> int:
    return max(1, min(PROBES, n_cells(dims) // PROBE_SHARE))


def _ranks(dims: int, seed: int = SEED) -> np.ndarray:
    """For cosines 0, 1 / STEPS, ..., 1, of drawn pairs of vectors of that cosine: how many cells
    are nearer to the one than the other's cell is, ascending. Rotated at random, a pair is
    any pair of its cosine, so nothing else about the vectors matters."""
    rng = np.random.default_rng(seed)
    near = np.arange(STEPS + 1)[:, None] / STEPS
    out = np.empty((STEPS + 1, DRAWN), np.int64)
    for i in range(DRAWN):
        sides, own = [], 0.0
        for _ in range(2):
            q, z = rng.normal(size=(2, dims))
            q /= np.sqrt(q @ q)
            z -= (z @ q) * q
            x = near * q + np.sqrt(1 - near * near) * (z / np.sqrt(z @ z))
            at = np.abs(x).argmax(axis=1)
            own = own + q[at] * np.sign(x[np.arange(len(x)), at])
            sides.append(np.concatenate([q, -q]))
        above = np.sort(sides[1])
        out[:, i] = (len(above) - np.searchsorted(above, own[:, None] - sides[0], "right")).sum(axis=1)
    return np.sort(out, axis=1)


@lru_cache
def depths(dims: int, tables: int) -> np.ndarray:
    """For cosines 0, 1 / STEPS, ..., 1: the cells to probe in each table after the first ones,
    so that all tables together find a row of that cosine with the chance AIM."""
    dims = 1 << max(0, dims - 1).bit_length()
    first, every = first_tables(tables), n_cells(dims)
    if dims == 1 or first == tables:
        return np.full(STEPS + 1, every)
    ranks = _ranks(dims)
    missed = (ranks >= first_probes(dims)).mean(axis=1) ** first
    hit = 1 - np.minimum(1, (1 - AIM) / np.maximum(missed, 1e-12)) ** (1 / (tables - first))
    nth = np.ceil(hit * DRAWN).astype(np.int64)
    cells = np.where(nth > 0, ranks[np.arange(STEPS + 1), np.maximum(nth, 1) - 1] + 1, 1)
    return np.clip(np.maximum.accumulate(cells[::-1])[::-1], min(LEAST_PROBES, every), every)


def probes_for(cosine: np.ndarray | float, depth: np.ndarray | None = None) -> np.ndarray:
    """Cells to probe in each table after the first ones, for a query whose k-th nearest so far
    has this cosine; depth: of depths(), by default for 64 dimensions and TABLES tables."""
    depth = depths(64, TABLES) if depth is None else depth
    return depth[np.clip(np.floor(np.asarray(cosine) * STEPS), 0, STEPS).astype(np.int64)]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def best(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, q: np.ndarray, asker: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine): the k nearest distinct ids of each query among the rows of the
    cells it asks for. asker, asked: a query's number and a cell, by query."""
    order = np.argsort(cell, kind="stable")
    ids, x = ids[order], scaled(x[order])
    q = scaled(q)
    norm_x, norm_q = length(x), length(q)
    low, high = np.searchsorted(cell[order], asked, "left"), np.searchsorted(cell[order], asked, "right")
    size = np.bincount(asker, high - low, len(q)).astype(np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    turns = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS)) if len(q) else []
    bounds = np.unique(np.concatenate([[0], np.minimum(np.asarray(turns, np.int64) + 1, len(q)), [len(q)]]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        i = slice(*np.searchsorted(asker, [a, b]))
        n = high[i] - low[i]
        row = np.repeat(low[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        who = np.repeat(asker[i], n)
        # each row of products is summed in the same order wherever it stands, so equal vectors tie
        score = np.concatenate([np.zeros(0), *[(x[row[j : j + PAIRS]] * q[who[j : j + PAIRS]]).sum(axis=1) for j in range(0, len(row), PAIRS)]]) / (norm_x[row] * norm_q[who])
        by = np.lexsort((ids[row], -score, who))
        who, own, score = who[by], ids[row][by], score[by]
        # the nearest row of an id stands for it
        seen = np.lexsort((np.arange(len(who)), own, who))
        again = np.concatenate(([False], (who[seen][1:] == who[seen][:-1]) & (own[seen][1:] == own[seen][:-1]))) if len(who) else np.zeros(0, bool)
        fresh = np.ones(len(who), bool)
        fresh[seen[again]] = False
        who, own, score = who[fresh], own[fresh], score[fresh]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((who[nth < k], own[nth < k], score[nth < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet(dims: int, k: int):
    """The function of a group: rows (cell, id, v) and queries (cells, q, h, v)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asks = right.column("cells").combine_chunks()
        asker = np.repeat(np.arange(right.num_rows), np.diff(asks.offsets.to_numpy()))
        who, own, score = best(left.column("id").to_numpy(), _matrix(left.column("v"), dims), left.column("cell").to_numpy(), _matrix(right.column("v"), dims), asker, asks.flatten().to_numpy(), k)
        return pa.table({"q": right.column("q").to_numpy()[who], "h": right.column("h").to_numpy()[who], "vec_id": own, "score": score})

    return run


def neighbours(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None, seed: int = SEED) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score double. probes: cells a query
    looks into in each table, by default as many as its own neighbours require."""
    v = F.col(vector_col)
    kind = "float" if dict(table.dtypes)[vector_col] == "array<float>" else "double"
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = table.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), v.cast(f"array<{kind}>").alias("v"), F.size(v).alias("dims")).where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda c: c != 0))
    rows = stash(rows, "vectors")
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = rows.where(F.col("dims") == dims).drop("dims")
    turns = signs(int(n_cells(dims) ** 0.5) // 2, 2 * tables, seed).reshape(tables, 2, 3, -1)
    # of equal vectors the k + 1 smallest ids
    few = Window.partitionBy("v").orderBy("id")
    own = stash(rows.select("id", "v").distinct().withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1).select("id", "v"), "indexed")
    asking = rows.where("is_query").select("id", "v").distinct()
    # (q, h) names a vector that is asked for: the smallest id that asks, and its hash
    heads = stash(asking.groupBy("v").agg(F.min("id").alias("q")).withColumn("h", F.xxhash64("v")), "asked")
    n = own.count()
    n_blocks = min(n_cells(dims), max(1, -(-n // BLOCK_ROWS)))
    width = -(-n_cells(dims) // n_blocks)
    run = _meet(dims, k + 1)

    def meet(heads: DataFrame, since: int, until: int, depth: np.ndarray | None, what: str) -> DataFrame:
        """What heads (v, q, h, cosine) find in some of the tables; depth: cells to probe by cosine."""

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = padded(_matrix(batch.column(1), dims))
                for t in range(since, until):
                    cell = cells(unit, turns[t])
                    yield pa.RecordBatch.from_arrays([pa.array(t * n_blocks + cell.astype(np.int64) // width), pa.array(cell), batch.column(0), batch.column(1)], ["b", "cell", "id", "v"])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = padded(_matrix(batch.column(0), dims))
                many = probes_for(batch.column(3).to_numpy(), depth)
                for m in np.unique(many):
                    alike, some = np.flatnonzero(many == m), max(1, (1 << 22) // int(m))
                    for rows in (alike[i : i + some] for i in range(0, len(alike), some)):
                        for t in range(since, until):
                            cell = probed(unit[rows], turns[t], int(m))
                            block = cell.astype(np.int64) // width
                            new = np.concatenate([np.ones((len(cell), 1), bool), block[:, 1:] != block[:, :-1]], axis=1)
                            at = np.flatnonzero(new)
                            who = pa.array(rows[at // cell.shape[1]])
                            lists = pa.ListArray.from_arrays(pa.array(np.append(at, cell.size).astype(np.int32)), pa.array(cell.ravel()))
                            yield pa.RecordBatch.from_arrays([pa.array(t * n_blocks + block.ravel()[at]), lists, *[batch.column(i).take(who) for i in (1, 2, 0)]], ["b", "cells", "q", "h", "v"])

        indexed = own.mapInArrow(index, f"b long, cell int, id long, v array<{kind}>")
        asked = heads.select("v", "q", "h", "cosine").mapInArrow(probe, f"b long, cells array<int>, q long, h long, v array<{kind}>")
        full = indexed.groupBy("b").count().where(F.col("count") > 2 * BLOCK_ROWS)
        full = stash(full.select("b", F.ceil(F.col("count") / BLOCK_ROWS).alias("parts")), "full")
        parts = F.coalesce("parts", F.lit(1))
        indexed = indexed.join(full, "b", "left").withColumn("s", F.pmod(F.xxhash64("id"), parts)).drop("parts")
        asked = asked.join(full, "b", "left").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        met = stash(_top(indexed.groupBy("b", "s").cogroup(asked.groupBy("b", "s")).applyInArrow(run, FOUND), k + 1), what)
        unstash(full)
        return met

    first = first_tables(tables) if probes is None else tables
    even = np.full(STEPS + 1, first_probes(dims) if probes is None else min(probes, n_cells(dims)))
    found = meet(heads.withColumn("cosine", F.lit(0.0)), 0, first, even, "found")
    so_far = heads.join(found.groupBy("q", "h").agg(F.count("*").alias("count"), F.min("score").alias("cosine")), ["q", "h"], "left")
    is_short = F.coalesce("count", F.lit(0)) <= k
    if probes is None:
        depth = depths(dims, tables)
        # from this cosine on the other tables take fewer cells than a table has
        worth = np.flatnonzero(depth * (tables - first) < n_cells(dims))
        is_short = is_short | (F.col("cosine") < (float(worth[0]) / STEPS if len(worth) else float("inf")))
    so_far = stash(so_far.withColumn("short", is_short), "so_far")
    short = so_far.where("short").select("v", "q", "h")
    if first < tables:
        early, later = found, meet(so_far.where("not short"), first, tables, depth, "more")
        found = stash(_top(early.union(later), k + 1), "found")
        unstash(early, later)
    if n_short := short.count():
        shards, blocks = max(1, -(-n // BLOCK_ROWS)), -(-n_short // BLOCK_QUERIES)
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        left = own.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("b"), every(blocks).alias("s"), F.lit(0).alias("cell"), "id", "v")
        right = short.select(every(shards).alias("b"), F.pmod("h", F.lit(blocks)).alias("s"), F.array(F.lit(0)).alias("cells"), "q", "h", "v")
        every_row = found.union(left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, FOUND))
        early, found = found, stash(_top(every_row, k + 1), "found")
        unstash(early)
    answers = asking.join(heads, "v").select(F.col("id").alias("query_id"), "q", "h").join(found, ["q", "h"]).where("vec_id <> query_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = stash(answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    unstash(rows, own, heads, found, so_far)
    return done


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each vector asked for, each once."""
    by = Window.partitionBy("q", "h").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("q", "h", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).drop("nth")
