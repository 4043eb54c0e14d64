"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, warc
from .common import shared_path
from .oracles import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.cut(_table(spark, sf_dir, "documents"), width=50)
    return done.select("doc_id", "n_bytes", suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_edits() -> Column:
    """Four edits of each text: an insertion, a deletion, a replacement and an addition, at
    places that follow from the id and the length."""
    n, i = F.coalesce(F.length("text"), F.lit(0)).cast("long"), F.coalesce("doc_id", F.lit(0))
    place = lambda k: F.pmod(i * k, n + 1).cast("long")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), t.alias("text"))
    end = F.lit(2_000_000_000)
    return F.array(
        edit(place(7919), place(7919), F.concat(F.lit(" edit"), i.cast("string"), F.lit("  "))),
        edit(place(104729), place(104729) + 12, F.lit("")),
        edit(place(1299709), place(1299709) + 3, F.lit("\n\nnew words, here ")),
        edit(end, end, F.lit(" the end.")),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), edits=op4_edits())


#: The conversation that op5's contract adds.
ADDED = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(added)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_suffix_dedup, op3_packing, op4_token_counts, op5_chat_format, op6_mixing, op7_warc, op8_ann, op9_quality_classifier, op10_simhash, pipeline)
}

__all__ = ["ORACLE", "QUERIES"]
