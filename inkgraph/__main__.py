"""Command line.

    python -m inkgraph query NAME DATA_DIR OUT_DIR     a core query over Parquet tables
    python -m inkgraph STEP CASE_DIR OUT_DIR [CASE_ID] a step over the text files of a case:
        discover, preprocess, ner, coref, full (to events), case (to the graph, with verification, ranks and timing)
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import text
from inkgraph.operators import casework, graph
from inkgraph.plans import registry
from inkgraph.session import build_session
from inkgraph.sources import files

STEPS = {"discover": ["documents"], "preprocess": ["segments", "sentences"], "ner": ["sentences", "entities"], "coref": ["clusters", "pool"], "full": ["sentences", "entities", "pool", "unified", "relations", "events"], "case": ["documents", "timeline", "nodes", "edges"]}


def of_files(docs: DataFrame) -> DataFrame:
    """Documents of a case directory, normalised by their kind."""
    t = F.col("text")
    raw = F.when(F.col("doc_type") == "narrative", text.expand(text.narrative(t))).when(F.col("doc_type") == "biography", text.biography(t)).otherwise(text.interview(t))
    return docs.select("case_id", F.col("doc_id").alias("doc_name"), "doc_type", raw.alias("raw_text")).where("trim(raw_text) != ''")


def run_step(spark, step: str, directory: str, out: str, case_id: str = "CASE") -> dict[str, float]:
    """Runs a step and writes its tables as JSON under ``out``; gives the seconds of each part."""
    timing: dict[str, float] = {}
    began = last = time.time()

    def lap(name: str) -> None:
        nonlocal last
        timing[name], last = round(time.time() - last, 3), time.time()

    found = files.case_documents(spark, directory, case_id)
    if not found.limit(1).count():
        raise FileNotFoundError(f"no case documents under {directory}")
    lap("document_discovery")
    files.save_json(files.manifest(found), f"{out}/manifest")
    if step != "discover":
        stages = casework.run(of_files(found))
        lap("document_processing")
        for name in STEPS[step]:
            files.save_json(stages[name], f"{out}/{name}")
            lap(name)
        if step == "case":
            files.save_json(casework.verify(stages), f"{out}/verification")
            lap("verification")
            edges = stages["edges"].select(F.col("source").alias("source_id"), F.col("target").alias("target_id"))
            scores, method = graph.ranks_or_fallback(edges, stages["nodes"].select("id"))
            files.save_json(graph.ranked(scores, stages["nodes"].select("id", "text", "label")).withColumn("method", F.lit(method)), f"{out}/pagerank")
            lap("pagerank_calculation")
    timing["total_pipeline_time"] = round(time.time() - began, 3)
    files.save_json(spark.createDataFrame(list(timing.items()), "stage string, seconds double"), f"{out}/timing")
    return timing


def main(args: list[str]) -> int:
    known = registry.queries()
    if len(args) == 4 and args[0] == "query" and args[1] in known:
        known[args[1]](build_session(), args[2]).write.mode("overwrite").parquet(args[3])
        return 0
    if len(args) in (3, 4) and args[0] in STEPS:
        try:
            print(run_step(build_session(), *args))
            return 0
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
    print(__doc__, "\nQueries:", *sorted(known))
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
