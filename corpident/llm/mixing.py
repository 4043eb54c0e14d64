"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over
its size. Documents are ordered within their source by size and id; the expected copies are
summed along that order from one offset drawn per source, and a document is taken once for
each whole number its interval crosses. Ordering by size spreads long and short documents
evenly over the sample, so the words taken stay within about one long document of the target.

Targets: the budget is shared by weight. A source stops at `cap` times its size and its
excess is shared anew among the others by weight, until none is above its stop. Sources are
never collected; each round is one small aggregate.

Nulls and edge cases: a null or wordless text has size 0, is expected like the others and
adds nothing; a source of size 0 has target 0 and gives no copies; the null source is the
last; rows with a null id come first among equal sizes; repeated rows count one by one; an
empty table gives an empty result; other columns, whatever their names, are kept by take() and
ignored by plan(), where keep may not name a column of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_keep, ranked, spread_join, stash, word_count

#: Weights in the code point order of sources, repeating.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """sized: source, size. One row per source: source, source_size long, target double."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = ranked(by.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_n")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = stash(by.select("source", "source_size", weight.alias("weight")), "sources")
    # all in hundredths of words, in whole numbers, so that reruns and other engines agree exactly
    budget = (by.agg(F.sum("source_size")).first()[0] or 0) * share_percent
    limit = F.col("source_size") * F.lit(100 * cap)
    left, shares = budget, None
    while True:
        # stopped: those whose share at the present rate is at or above their stop
        stopped = F.lit(False) if shares is None else F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)") >= limit.cast("decimal(38,0)") * F.lit(shares).cast("decimal(38,0)")
        full, free = by.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight")))).first()
        now = (budget - int(full or 0), int(free or 0))
        if now[1] == 0 or now == (left, shares):
            break
        left, shares = now
    rate = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(100 * (shares or 1)))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.lit(now[1] == 0) | stopped, F.col("source_size").cast("double") * cap).otherwise(rate)
    return by.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, and keep."""
    check_keep(keep, ("doc_id", "source", "size", "source_size", "target", "copies"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    sized = stash(sized, "sizes")
    goals = targets(sized.select("source", "size"), weights, share_percent, cap)
    order = ["size", "doc_id", *[f"c{i}" for i in range(len(keep))]]
    rows = ranked(sized.withColumn("_null", F.col("source").isNull()), ["_null", "source"], order, "n")
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_null")
    # the offset: 20 bits of a digest of the seed and the source, in [0, 1)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_e", each).withColumn("_u", drawn)
    upto = lambda n: F.floor(n.cast("double") * F.col("_e") + F.col("_u"))
    copies = F.least(upto(F.col("n")) - upto(F.col("n") - 1), F.ceil("_e"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, in the same columns."""
    # the row travels in one struct, so that no name of the caller's can clash
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{source_col}`").alias("source"),
        F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")).alias("key"),
    )
    planned = plan(rows, "id", "text", "source", keep=("key",), **how)
    # rows equal in every column are told apart by nothing: their copies are summed, shared
    # evenly, and what is left over goes to one of them
    times = planned.groupBy("key").agg(F.sum("copies").alias("taken"), F.count("*").alias("rows")).where("taken > 0")
    times = stash(times.select("key", "rows", F.floor(F.col("taken") / F.col("rows")).alias("each"), (F.col("taken") % F.col("rows")).alias("rest")), "copies")
    own = rows.select("row", "key")
    many = spread_join(own, times.where("each > 0").select("key", "rows", "each"), "key", "rows", F.rand(0)).select("row", F.col("each").alias("n"))
    if times.where("rest > 0 and rows > 1").limit(1).count():
        over = own.join(times.where("rest > 0 and rows > 1").select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        many = many.union(over.join(times.select("key", "rest"), "key").select("row", F.col("rest").alias("n")))
    out = many.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
