"""Verification, metrics and referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(entities: DataFrame, relations: DataFrame, events: DataFrame, min_relations: int = 5) -> DataFrame:
    """Per case: counts and whether all checks pass; three pre-aggregated sides are joined, never the rows."""
    e = entities.groupBy("case_id").agg(F.count("*").alias("n_entities"), F.count_if(F.col("entity_name").isNull()).alias("bad_entities"))
    r = relations.groupBy("case_id").agg(F.count("*").alias("n_relations"), F.count_if(F.col("subject_text").isNull() | F.col("object_text").isNull()).alias("bad_relations"))
    v = events.groupBy("case_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_id").isNull()).alias("bad_events"))
    out = e.join(r, "case_id", "full").join(v, "case_id", "full").fillna(0)
    ok = (F.col("n_entities") > 0) & (F.col("n_relations") >= min_relations) & (F.col("n_events") > 0) & (F.col("bad_entities") + F.col("bad_relations") + F.col("bad_events") == 0)
    return out.withColumn("passed", ok)


def malformed(entities: DataFrame, relations: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, row_id, message) of rows that miss what they need."""
    a = entities.where("entity_name is null").select(F.lit("entity").alias("kind"), F.col("id").alias("row_id"), F.lit("entity without text").alias("message"))
    b = relations.where("subject_text is null or object_text is null").select(F.lit("relation").alias("kind"), F.col("rel_id").alias("row_id"), F.lit("relation without subject or object").alias("message"))
    c = events.where("event_id is null").select(F.lit("event").alias("kind"), F.col("id").alias("row_id"), F.lit("event without id").alias("message"))
    return a.unionByName(b).unionByName(c)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values of a column, null being its own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row: the check that a foreign key stands for."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def categories(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(part, value, n): the count of each value, their total, how many values there are, and the ``top`` most frequent."""
    h = histogram(df, column)
    none = F.lit(None).cast("string")
    all_ = h.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    totals = all_.select(F.explode(F.array(F.struct(F.lit("total").alias("part"), none.alias("value"), F.coalesce("total", F.lit(0)).alias("n")), F.struct(F.lit("types").alias("part"), none.alias("value"), F.col("types").alias("n")))).alias("x")).select("x.*")
    best = h.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top)
    return h.select(F.lit("type").alias("part"), "value", "n").unionByName(totals).unionByName(best.select(F.lit("top").alias("part"), "value", "n"))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first rows by an order: a sample for display."""
    return df.orderBy(order).limit(n)


def report(nodes: DataFrame, edges: DataFrame, scores: DataFrame, documents: DataFrame) -> DataFrame:
    """(section, key, value): the figures of a run: nodes by type and label, edges by kind, ranks (times the number of nodes), documents."""
    from inkgraph.operators.graph import ranked

    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("double").alias("value"))
    count = lambda df, section, key: row(df.agg(F.count("*").alias("n")), section, key, F.col("n"))
    stats = scores.agg(F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.count("*").alias("n"))
    kinds = edges.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("edge_type", F.lit("unknown"))).alias("types"))
    parts = [
        count(nodes, "graph_statistics", "total_nodes"), count(edges, "graph_statistics", "total_edges"), row(nodes.groupBy("type").agg(F.count("*").alias("n")), "node_types", F.col("type"), F.col("n")),
        row(nodes.where("type = 'Entity'").groupBy(F.coalesce("label", F.lit("unknown")).alias("l")).agg(F.count("*").alias("n")), "entity_labels", F.col("l"), F.col("n")), count(ranked(scores).where("is_significant"), "pagerank", "significant_nodes"),
        *[row(stats, "pagerank", k, F.round(F.col(k) * F.col("n"), 4)) for k in ("min", "max", "mean", "median")], row(kinds, "relation_analysis", "total_relations", F.col("n")), row(kinds, "relation_analysis", "unique_relation_types", F.col("types")),
        count(documents, "case_information", "documents"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
