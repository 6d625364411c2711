"""Schemas of the stored tables: columns, keys and what happens to child rows, and the checks that stand for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stored tables: columns with type and default.
TABLES: dict[str, str] = {
    "cases": "case_id STRING, title STRING, reporting_officer STRING, investigating_officer STRING, status STRING DEFAULT 'Open', created_at TIMESTAMP, updated_at TIMESTAMP",
    "rawfiles": "id BIGINT, case_id STRING, filename STRING, file_desc STRING",
    "documents": "id BIGINT, case_id STRING, doc_type STRING, title STRING, content STRING, created_at TIMESTAMP",
    "narratives": "id BIGINT, case_id STRING, type STRING, text STRING",
    "victim_biographies": "id BIGINT, case_id STRING, victim_name STRING, biography STRING",
    "suspect_interviews": "id BIGINT, case_id STRING, suspect_name STRING, interview_text STRING, interview_date TIMESTAMP",
    "entities": "id BIGINT, case_id STRING, entity_type STRING, entity_name STRING, normalized_name STRING, global_id BIGINT",
    "events": "id BIGINT, case_id STRING, description STRING, timestamp TIMESTAMP, location STRING, entities_involved ARRAY<BIGINT>, actor_global_id BIGINT",
    "relations": "id BIGINT, case_id STRING, subject_id BIGINT, predicate STRING, object_id BIGINT, subject_global_id BIGINT, object_global_id BIGINT",
    "global_entities": "global_id BIGINT, case_id STRING, canonical_name STRING, entity_type STRING, source_docs ARRAY<STRING>",
}
#: Child, key, parent, parent key, what a deleted parent does to the child (cascade, null, or nothing).
KEYS: list[tuple[str, str, str, str, str]] = [
    *[(t, "case_id", "cases", "case_id", "cascade") for t in TABLES if t != "cases"],
    ("entities", "global_id", "global_entities", "global_id", "null"), ("relations", "subject_id", "entities", "id", "cascade"), ("relations", "object_id", "entities", "id", "cascade"),
    ("relations", "subject_global_id", "global_entities", "global_id", ""), ("relations", "object_global_id", "global_entities", "global_id", ""), ("events", "actor_global_id", "global_entities", "global_id", ""),
]


def schema(name: str) -> T.StructType:
    columns = TABLES[name].replace(" DEFAULT 'Open'", "")
    return T.StructType.fromDDL(columns)


def ddl(name: str, using: str = "parquet") -> str:
    """The statement that makes a table; keys are checks here (:func:`broken`), not constraints."""
    columns = TABLES[name].replace(" DEFAULT 'Open'", "")
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}"


def conform(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame with the columns of a model in their order and types: missing ones null or at their default, extra ones off."""
    default = {"status": F.lit("Open")} if name == "cases" else {}
    have = set(df.columns)
    cols = []
    for f in schema(name).fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, default[f.name]) if f.name in default else c).alias(f.name))
    return df.select(cols)


def broken(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, key, n): how many child rows of the given tables have a key without its parent row."""
    out = []
    for child, key, parent, parent_key, _ in KEYS:
        if child in tables and parent in tables and key in tables[child].columns:
            rows = tables[child].where(F.col(key).isNotNull()).select(key).join(tables[parent].select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
            out.append(rows.agg(F.lit(child).alias("child"), F.lit(key).alias("key"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


def delete(tables: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` whose key is in ``gone``, with what their keys do to child rows.

    Cascades follow from table to table; keys that are set to null keep their rows.
    """
    out = dict(tables)
    key = {"cases": "case_id", "global_entities": "global_id"}.get(name, "id")
    dead = gone.select(key).distinct()
    out[name] = out[name].join(dead, key, "left_anti")
    for child, ck, parent, pk, then in KEYS:
        if parent != name or child not in out or ck not in out[child].columns or not then:
            continue
        hit = dead.select(F.col(pk).alias(ck))
        if then == "null":
            marked = out[child].join(hit.withColumn("_gone", F.lit(True)), ck, "left")
            out[child] = marked.withColumn(ck, F.when(F.col("_gone").isNull(), F.col(ck))).select(out[child].columns)
        else:
            own = {"cases": "case_id", "global_entities": "global_id"}.get(child, "id")
            lost = out[child].join(hit, ck, "left_semi").select(own)
            out = delete(out, child, lost)
    return out
