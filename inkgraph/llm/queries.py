"""The queries of the ten problems; each reads its whole tables with the operators' production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgraph.session import ship
from inkgraph.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import canon

    ship(spark)
    ref = table(spark, sf, "relation_ref")
    edges = canon.map_values(table(spark, sf, "graph_edges"), "graph_edges", "edge_id", "edge_type", "edge_type", ref)
    rels = canon.map_values(table(spark, sf, "edges_relations"), "edges_relations", "rel_id", "predicate", "predicate", ref)
    return edges.unionByName(rels)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import sentences

    ship(spark)
    return sentences.find(table(spark, sf, "narratives"), table(spark, sf, "victim_biographies"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import names

    ship(spark)
    return names.find(table(spark, sf, "entities"), table(spark, sf, "global_entities"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention with the class of its entity: one row per row instead of pairs."""
    from inkgraph.llm import names

    ship(spark)
    return names.classes(table(spark, sf, "entities"), table(spark, sf, "global_entities"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import turns

    ship(spark)
    return turns.speaker_turns(table(spark, sf, "suspect_interviews")).select("id", "turn_no", "speaker")


def p4_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The clean turns with their words."""
    from inkgraph.llm import turns

    ship(spark)
    return turns.speaker_turns(table(spark, sf, "suspect_interviews"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import pii

    ship(spark)
    return pii.find(pii.gather(table(spark, sf, "documents"), table(spark, sf, "suspect_interviews"), table(spark, sf, "victim_biographies")))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The texts with typed placeholders."""
    from inkgraph.llm import pii

    ship(spark)
    return pii.redact(pii.gather(table(spark, sf, "documents"), table(spark, sf, "suspect_interviews"), table(spark, sf, "victim_biographies")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import scans

    ship(spark)
    return scans.find(scans.gather(table(spark, sf, "documents"), table(spark, sf, "narratives")))


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged texts as continuous paragraphs."""
    from inkgraph.llm import scans

    ship(spark)
    return scans.repair(scans.gather(table(spark, sf, "documents"), table(spark, sf, "narratives")))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import pack

    ship(spark)
    return pack.pack(pack.token_sizes(table(spark, sf, "documents")), table(spark, sf, "pack_specs"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used against the lower bound, per capacity."""
    from inkgraph.llm import pack

    ship(spark)
    specs = table(spark, sf, "pack_specs")
    return pack.report(pack.pack(pack.token_sizes(table(spark, sf, "documents")), specs), specs)


def p9_mixed(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import mix

    ship(spark)
    return mix.mix(mix.sized(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that each mix reaches."""
    from inkgraph.llm import mix

    ship(spark)
    docs, targets = mix.sized(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    return mix.shares(mix.mix(docs, targets), docs, targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from inkgraph.llm import mojibake

    ship(spark)
    return mojibake.find(table(spark, sf, "documents"))


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged documents with their restored text."""
    from inkgraph.llm import mojibake

    ship(spark)
    return mojibake.restore(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
