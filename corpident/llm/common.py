"""What several operators share: cutting lineage, distributed ranks, word counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A session without one gets a folder of this machine
    only if the whole of Spark runs on it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="corpident-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/corpident/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Deletes what this process wrote in the shared folder; tables that still read it are lost."""
    while _written:
        _delete(spark, _written.pop())


def stash(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and
    a lost executor costs no recomputation. unstash() deletes it once nothing reads it."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stashed = path
    return table


def unstash(*tables: DataFrame) -> None:
    """Deletes stashed tables, for when all that reads them has itself been written. What is
    not a stashed table stays."""
    for table in tables:
        path = getattr(table, "_stashed", None) if "_stashed" in vars(table) else None
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


def check_keep(keep: tuple[str, ...], taken: tuple[str, ...]) -> None:
    """Carried columns come back under their own names, so those must not be the result's."""
    if clash := [c for c in keep if c in taken]:
        raise ValueError(f"rename {', '.join(clash)} first: the result has columns of these names")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shingle_hashes(text: bytes | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words, in order and with repeats; fewer words are one run, none
    none. Bytes are split: only A-Z change to a-z, only ASCII white space divides."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > k:
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows told by the columns: their order, where each run of equal rows starts, and its length."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def dealt(rows: DataFrame, key: str, member: str, parts: Column, groups: int) -> DataFrame:
    """rows with g, lo and hi: the rows of a key fall into so many parts by their member, and
    for each pair of parts (lo <= hi) the rows of both share a group g. Any two rows of a key
    meet in a group, and no group holds more than two parts of a key."""
    x = F.pmod(F.xxhash64(member), F.greatest(parts, F.lit(1)))
    rows = rows.withColumns({"_x": x, "_y": F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)).cast("long") - 1))})
    rows = rows.withColumns({"lo": F.least("_x", "_y").cast("int"), "hi": F.greatest("_x", "_y").cast("int")}).drop("_x", "_y")
    return rows.withColumn("g", F.pmod(F.xxhash64(key, "lo", "hi"), F.lit(groups)))


#: Rows of one key that a join sends to one task, about.
HOT_ROWS = 1 << 20


def spread_join(many: DataFrame, one: DataFrame, key: str, copies: str, by: str | Column) -> DataFrame:
    """many joined to one on key, where one has a row per key and knows how many rows of many
    have it (copies): keys of very many rows are dealt over several tasks, by the column by."""
    hot = stash(one.where(F.col(copies) > 2 * HOT_ROWS).select(key, F.ceil(F.col(copies) / HOT_ROWS).alias("_parts")), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    many = many.join(hot, key, "left").withColumn("_s", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    one = one.drop(copies).join(hot, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return many.join(one, [key, "_s"]).drop("_s")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds the 1-based position of each row in its group, in the stated order.

    A range exchange on group and order cuts large groups into many partitions. Each
    partition numbers its own rows, and the partitions' row counts (one row per group and
    partition) give every partition its offset, so no group meets in one task.
    """
    cut = df.repartitionByRange(partitions(df.sparkSession), *group, *order)
    cut = stash(cut.withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_part", *group)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], "_offset")
    )
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy("_part", *group).orderBy(*order)
    return (
        cut.join(offsets, on)
        .withColumn(rank, F.col("_offset") + F.row_number().over(own))
        .drop("_part", "_p", "_offset", *[f"_k{i}" for i in range(len(group))])
    )
