"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.operators.timestamps import case_times
from inkgraph.sources.tables import table


def _times(spark: SparkSession, sf: str) -> DataFrame:
    return case_times(table(spark, sf, "case_events"), table(spark, sf, "victim_biographies"), table(spark, sf, "agency_ref"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).where(F.col("instant").isNotNull()).select("src", "row_id", "item_no", "instant")


def p5_status(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the values, by source."""
    return _times(spark, sf).where(F.col("text").isNotNull()).groupBy("src", "status").agg(F.count("*").alias("n"))
