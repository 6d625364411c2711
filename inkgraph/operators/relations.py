"""Relations: types by verb, quality filter, joins with entities and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import fixed


def verb_forms(lemma_: str) -> list[str]:
    """A verb's base form, third person, past and participles, by rule and by the list of irregular ones."""
    if lemma_ in fixed.NOUN_PREDICATES:
        return [lemma_]
    if lemma_ == "be":
        return [lemma_, *fixed.IRREGULAR_VERBS[lemma_].split()]
    y = lemma_.endswith("y") and lemma_[-2] not in "aeiou"
    stem = lemma_[:-1] if lemma_.endswith("e") else lemma_
    third = lemma_[:-1] + "ies" if y else lemma_ + ("es" if lemma_.endswith(("s", "x", "ch", "sh")) else "s")
    past = fixed.IRREGULAR_VERBS[lemma_].split() if lemma_ in fixed.IRREGULAR_VERBS else [lemma_[:-1] + "ied" if y else stem + "ed"]
    return list(dict.fromkeys([lemma_, third, *past, (lemma_ if lemma_ in ("see",) else stem) + "ing"]))


def _forms() -> dict[str, str]:
    return {f: v for v in ["be", *fixed.VERB_TYPES] for f in verb_forms(v)}


def verb_pattern() -> str:
    """(before, verb form, behind) of the first listed verb of a clause that has words on both sides; tried at clause starts only."""
    inside = r"[^,;:.!?“”\"]"
    return rf"(?is)(?:^|[,;:.!?“”\"])\s*({inside}*?\s)(" + "|".join(sorted(_forms(), key=lambda f: (-len(f), f))) + rf")(\s{inside}*)"


def lemma(form: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in _forms().items() for x in kv])[F.lower(form)]


def relation_type(predicate: Column) -> Column:
    """The type of relation that a whole predicate states; null for predicates outside the table."""
    table = F.create_map(*[F.lit(x) for kv in fixed.VERB_TYPES.items() for x in kv])
    return table[F.lower(F.trim(predicate))]


def edge_type(relation: Column) -> Column:
    """The edge that a type of relation gets; null for types without one."""
    table = F.create_map(*[F.lit(x) for k in fixed.EDGE_TYPES for x in (k, k)], *[F.lit(x) for kv in fixed.EDGE_OF_TYPE.items() for x in kv])
    return table[relation]


def edge_or_owns(relation: Column, object_norm: Column) -> Column:
    """The edge of a type of relation, else OWNS where the object holds a word of what is owned, else null."""
    return F.coalesce(edge_type(relation), F.when(object_norm.rlike("|".join(fixed.OWNED)), "OWNS"))


def entity_index(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with name and type of their subject and object (missing ones stay)."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("entity_name").alias("subject_name"), F.col("entity_type").alias("subject_type"))
    o = entities.select(F.col("id").cast("bigint").alias("object_id"), F.col("entity_name").alias("object_name"), F.col("entity_type").alias("object_type"))
    return relations.join(s, "subject_id", "left").join(o, "object_id", "left")


def short_and_named(relations: DataFrame, entities: DataFrame, most: int = 15) -> DataFrame:
    """Relations whose arguments are short and, where their document has entities, name one of them."""
    e = entities.where("trim(entity_name) != ''").select("case_id", "doc_name", F.lower(F.trim("entity_name")).alias("name")).distinct()
    per_doc = e.groupBy("case_id", "doc_name").agg(F.collect_set("name").alias("names"))  # the entities of one document
    words = lambda c: F.size(F.split(F.trim(F.col(c)), r"\s+"))
    r = relations.where((words("subject_text") <= most) & (words("object_text") <= most)).join(per_doc, ["case_id", "doc_name"], "left")
    named = F.exists("names", lambda n: F.contains(F.lower(F.col("subject_text")), n) | F.contains(F.lower(F.col("object_text")), n))
    return r.where(F.col("names").isNull() | named).drop("names")
