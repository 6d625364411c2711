"""Order-dependent operators that stay spread out: positions, running sums and neighbours in two levels.

A window over a whole key would put a hot key into one task.  Here rows are windowed inside buckets of the order, and
only one row per bucket is windowed over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key; ``bucket`` must not decrease along the order."""
    cols = [F.col(k) for k in keys]
    df = df.withColumns({"_b": bucket, "_v": value})
    inner = F.sum("_v").over(Window.partitionBy(*cols, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    over = Window.partitionBy(*cols) if keys else Window.partitionBy(F.lit(0))
    base = sums.withColumn("_base", F.sum("_t").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    joined = df.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(base, [*keys, "_b"])
    return joined.withColumn(out, F.coalesce("_base", F.lit(0)) + F.col("_inner")).drop("_b", "_v", "_inner", "_base")


def position(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """0-based position of each row in its key."""
    return running(df, keys, bucket, order, F.lit(1), out).withColumn(out, F.col(out).cast("bigint"))


def following(df: DataFrame, keys: list[str], bucket: Column, order: list[str], fields: list[str]) -> DataFrame:
    """Each row with the struct ``following`` of ``fields`` of the next row of its key, null for the last."""
    df = df.withColumns({"_b": bucket, "_s": F.struct(*fields)})
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    heads = df.groupBy(*keys, "_b").agg(F.min_by("_s", F.struct(*order)).alias("_head"))
    heads = heads.withColumn("_next", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_head")
    return df.withColumn("_in", F.lead("_s").over(w)).join(heads, [*keys, "_b"]).withColumn("following", F.coalesce("_in", "_next")).drop("_b", "_s", "_in", "_next")
