"""Files as sources and sinks: case directories, manifests, uploads, graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions import text

MANIFEST = "case_id string, docs array<struct<doc_id:string,doc_type:string,title:string,path:string>>"
EDGES = "edge_id bigint, source_id string, target_id string, edge_type string, case_id string, doc_name string, doc_type string"


def case_documents(spark: SparkSession, directory: str, case_id: str) -> DataFrame:
    """(case_id, doc_id, doc_type, title, path, text) of the text files of a case; unknown kinds are passed over, a missing directory is empty."""
    schema = "case_id string, doc_id string, doc_type string, title string, path string, text string"
    try:
        raw = spark.read.text(f"{directory}/*.txt", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    d = raw.withColumn("doc_id", F.regexp_replace("file", r"\.txt$", "")).withColumn("doc_type", text.doc_type_of(F.col("file")))
    return d.where("doc_type is not null").select(F.lit(case_id).alias("case_id"), "doc_id", "doc_type", F.coalesce(text.first_line(F.col("text")), "doc_id").alias("title"), "path", "text")


def manifest(docs: DataFrame) -> DataFrame:
    return docs.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc_type", "title", "path"))).alias("docs"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON of a known schema; a missing path is empty, a bad record fails."""
    try:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_graph(nodes: DataFrame, edges: DataFrame, directory: str, nodes_name: str = "graph_nodes", edges_name: str = "graph_edges") -> tuple[str, str]:
    """Nodes and edges as two JSON tables; gives their paths."""
    paths = (f"{directory}/{nodes_name}", f"{directory}/{edges_name}")
    save_json(nodes, paths[0])
    save_json(edges, paths[1])
    return paths


def save_global_entities(pool: DataFrame, directory: str, case_id: str) -> str:
    """The pool of one case as JSON; gives its path."""
    path = f"{directory}/{case_id}_global_entities"
    save_json(pool.where(F.col("case_id") == case_id), path)
    return path


def enriched(spark: SparkSession, path: str, schema: str, enrich, suffix: str) -> str:
    """Reads processed JSON, enriches it and writes it beside the input under its name with a suffix; bad JSON is a ValueError."""
    try:
        df = spark.read.schema(schema).json(path, mode="FAILFAST", multiLine=True)
        target = (path[:-5] if path.endswith(".json") else path) + suffix + ".json"
        save_json(enrich(df), target)
    except Exception as e:
        if "MALFORMED" in str(e).upper():
            raise ValueError(f"invalid JSON in {path}") from e
        raise
    return target


def uploads(spark: SparkSession, path: str, read_pdf=None) -> DataFrame:
    """(name, text) of uploaded files: UTF-8, else Latin-1, whatever the suffix; PDF by ``read_pdf`` (bytes -> pages), else refused.

    Pages are joined by a blank line.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    pdf = F.lower("name").endswith(".pdf")
    if read_pdf is None and raw.where(pdf).limit(1).count():
        raise ValueError("PDF files need a reader")
    utf8 = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    out = raw.where(~pdf).select("name", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))
    if read_pdf is None:
        return out
    pages = F.udf(lambda b: "\n\n".join(read_pdf(bytes(b))), "string")  # one call a file
    return out.unionByName(raw.where(pdf).select("name", pages("content").alias("text")))
