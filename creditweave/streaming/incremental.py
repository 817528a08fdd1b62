"""Resumable scans: files are read once, progress is kept in a checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Appends what is new below ``source`` to ``target`` and ends; a later call goes on where this one ended."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = transform(stream) if transform else stream
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


def first_deliveries(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Rows of a stream without second deliveries of the same key within ``late``."""
    ts = F.col(at).cast("timestamp")
    return stream.withColumn(at, ts).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def monthly_counts(stream: DataFrame, at: str, late: str) -> DataFrame:
    """Rows by 30-day window of a stream, late rows accepted for ``late``."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "30 days")).agg(F.count(F.lit(1)).alias("n"))
