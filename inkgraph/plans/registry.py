"""All queries of the core by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.plans import case, core, pages, times  # noqa: F401  (case and pages register their queries in core)

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the timeline's BEFORE and AFTER edges, counted by kind."""
    return core.k6(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return {"p5_found": times.p5_found, "p5_status": times.p5_status, **core.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
