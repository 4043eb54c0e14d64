"""Connected components by alternating large-star and small-star steps, on nodes of any ordered type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def node(least_id: Column, key: Column) -> Column:
    """A node that is ordered by its smallest id, nulls last, so that the root of a component
    carries the component's id and nothing has to be looked up by root."""
    return F.struct(least_id.isNull().alias("none"), least_id.alias("id"), key.alias("key"))


def as_nodes(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """edges: a, b (keys). nodes: key, least_id. The same edges between nodes, see node()."""
    own = nodes.select(F.col(key).alias("_key"), node(F.col("least_id"), F.col(key)).alias("_node"))
    for c in ("a", "b"):
        edges = edges.join(own, F.col(c) == F.col("_key")).drop(c, "_key").withColumnRenamed("_node", c)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest node reachable from v, for nodes with an edge. edges: a, b.
    Every step's table is written, so lineage stays short, and goes once the next is."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(now)
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, now = now, stash(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        unstash(old)
        was, seen = seen, state(now)
        if was == seen:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
