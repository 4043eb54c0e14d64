"""A corpus from raw documents to packed batches, over the operators of the llm subpackage.

All stages read whole texts. Any column may be null and may have any name beside doc_id, text
and source; all but the last stage return the columns of documents as they came. An empty
table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpident.llm import mixing, packing, quality_classifier, simhash, suffix_dedup
from corpident.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, scores 0.5 or more. A null text is
    scored as an empty one, rows with a null id are scored too, repeated rows alike; without
    labels all scores are 0.5 and all documents stay."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near copies: five-word shingles, similarity
    0.8 or more. Null and wordless texts are copies of each other; of ties in text the smallest
    id stays; rows with a null id stay, and so do repeated rows of an id that stays."""
    return simhash.keep_one(docs, shingle=5, similarity=(4, 5))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes that an earlier one holds. A null text
    stays null, one that goes wholly becomes empty; rows with a null id come after all others,
    and rows of one id cut nothing from each other."""
    return suffix_dedup.cut_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for. The null source is the last;
    null and wordless texts have size 0, and a source of such texts alone gives no copies;
    repeated rows count one by one; equal sizes go by id, nulls first."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their batches. A null or empty text has no piece;
    repeated rows are packed one by one; equal lengths go by id, nulls first. Columns beside
    id and text end here."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("mix", mix), ("pack", pack)]
#: The method of most stages can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
