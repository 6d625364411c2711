"""An extension: the timeline and its counts over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(directory)


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
