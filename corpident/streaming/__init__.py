"""The same validation over streams: one narrow transformation, so append mode, no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpident import functions as api
from corpident.sources import INPUT


def read_stream(spark: SparkSession, path: str, format: str = "parquet", schema: str = INPUT, **options: str) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def validate_stream(stream: DataFrame, profile: str | None = "profile", **how) -> DataFrame:
    """Flat reports of a stream of identifiers."""
    return api.flatten(api.validate(stream, profile=profile, **how))


def write_stream(reports: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    return reports.writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
