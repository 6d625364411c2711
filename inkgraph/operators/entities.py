"""Entity pools, pronouns as of their nearest mention, constrained merges, main mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import fixed, text


def pool(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, norm): first label, distinct mentions and sources in order of appearance, id by first appearance.

    ``mentions``: keys, norm, mention, label, source, ord.  Pre-aggregated by mention, so a hot key carries few rows.
    """
    by_mention = mentions.groupBy(*keys, "norm", "mention").agg(F.min("ord").alias("m_ord"), F.min_by(F.struct("label"), "ord").alias("l"))
    by_source = mentions.groupBy(*keys, "norm", "source").agg(F.min("ord").alias("s_ord"))
    a = by_mention.groupBy(*keys, "norm").agg(F.min("m_ord").alias("first_ord"), F.min_by("l", "m_ord")["label"].alias("entity_type"), F.transform(F.array_sort(F.collect_list(F.struct("m_ord", "mention"))), lambda x: x["mention"]).alias("mentions"))
    b = by_source.groupBy(*keys, "norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_ord", "source"))), lambda x: x["source"]).alias("source_docs"))
    out = a.join(b, [*keys, "norm"])
    return out.withColumn("global_id", F.row_number().over(Window.partitionBy(*keys).orderBy("first_ord")).cast("bigint"))


def resolve_pronouns(tokens: DataFrame, key: str) -> DataFrame:
    """Pronoun tokens with the norm of the nearest mention before them: a backward as-of join by window.

    ``tokens``: key (a document), idx, token, mention (null where the token ends none).
    """
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    word = F.lower(F.regexp_replace("token", "[^A-Za-z]", ""))
    out = tokens.withColumn("antecedent", F.last("mention", ignorenulls=True).over(w)).withColumn("pronoun", word)
    return out.where(F.col("pronoun").isin(fixed.COREF_PRONOUNS) & F.col("antecedent").isNotNull()).select(key, "idx", "pronoun", "antecedent")


def merge_by_words(pool_: DataFrame, keys: list[str], groups: list[list[str]], whole_words: bool = True) -> DataFrame:
    """``pool_`` with ``into``: in passes, all entities of a key whose norm holds a word of a group go into its first one.

    What was merged takes no part in later passes but follows what it was merged into.  An entity leaves in the pass of the
    first group that it fits, so all that matters of a key is the first entity of each set of groups fitted: one small row
    per key, computed by a mergeable aggregate and joined back; no window runs over a key.
    """
    fits = lambda g: F.col("norm").rlike((r"(^|_)({})(_|$)" if whole_words else "({})").format("|".join(groups[g])))
    n = len(groups)
    bits = sum((F.when(fits(g), 1 << g).otherwise(0) for g in range(n)), F.lit(0))
    has = lambda b, g: b.bitwiseAND(F.lit(1 << g)) != 0
    lowest = lambda b, g: b.bitwiseAND(F.lit((2 << g) - 1)) == F.lit(1 << g)
    df = pool_.withColumn("_bits", bits)
    sets = df.where("_bits != 0").groupBy(*keys, "_bits").agg(F.min("global_id").alias("_id"))
    per_key = sets.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_bits").alias("bits"))).alias("_m"))
    for g in range(n):
        fresh = F.filter("_m", (lambda g: lambda x: lowest(x["bits"], g))(g))
        kept = F.filter(F.array(*[F.when(F.col(f"_dead{h}").isNull(), F.col(f"_f{h}")) for h in range(g)]), (lambda g: lambda x: x.isNotNull() & has(x["bits"], g))(g)) if g else None
        per_key = per_key.withColumn(f"_f{g}", F.array_min(F.concat(fresh, kept) if g else fresh))
        dead = {f"_dead{h}": F.when(F.col(f"_dead{h}").isNotNull(), F.col(f"_dead{h}")).when(has(F.col(f"_f{h}.bits"), g) & (F.col(f"_f{h}.id") != F.col(f"_f{g}.id")), g) for h in range(g)}
        per_key = per_key.withColumns({**dead, f"_dead{g}": F.lit(None).cast("int")})
    for g in reversed(range(n)):
        root = F.col(f"_f{g}.id")
        for k in range(g + 1, n):
            root = F.when(F.col(f"_dead{g}") == k, F.col(f"_root{k}")).otherwise(root)
        per_key = per_key.withColumn(f"_root{g}", root)
    out = df.join(per_key.select(*keys, *[f"_root{g}" for g in range(n)]), keys, "left")
    into = F.coalesce(*[F.when(lowest(F.col("_bits"), g), F.col(f"_root{g}")) for g in range(n)], F.col("global_id"))
    return out.withColumn("into", into).select(*pool_.columns, "into")


def merged_pool(pool_: DataFrame, keys: list[str], groups: list[list[str]]) -> DataFrame:
    """(keys, global_id, canonical_name, entity_type, mentions, source_docs) after the merges, by words anywhere in a norm.

    What is merged hands on its mentions (in order of ids, repeats kept) and sources; ids keep their gaps.
    """
    p = merge_by_words(pool_, keys, groups, whole_words=False)
    own = F.max_by(F.struct(F.col("norm").alias("canonical_name"), "entity_type"), F.col("global_id") == F.col("into"))
    out = p.groupBy(*keys, F.col("into").alias("global_id")).agg(own.alias("_o"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("global_id", "mentions"))), lambda x: x["mentions"])).alias("mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_docs")))).alias("source_docs"))
    return out.select(*keys, "global_id", "_o.*", "mentions", "source_docs")


def main_mention(mentions: Column) -> Column:
    """The longest mention that is no pronoun, the first among equals; null when there is none."""
    real = F.filter(mentions, lambda m: m.isNotNull() & ~F.lower(F.trim(m)).isin(fixed.PRONOUNS))
    best = F.aggregate(real, F.lit(None).cast("string"), lambda a, m: F.when(a.isNull() | (F.length(m) > F.length(a)), m).otherwise(a))
    return best


def replace_pronouns(body: Column, table: list[tuple[str, Column]]) -> Column:
    """Pronouns replaced one after the other, the longest first, on word bounds of any script."""
    ordered = sorted(table, key=lambda t: -len(t[0]))
    swap = lambda c, t: F.regexp_replace(c, F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}_])"), F.lit(t[0]), F.lit(r"($|[^\p{L}\p{N}_])")), F.concat(F.lit("$1"), F.regexp_replace(t[1], r"([\\$])", r"\\$1"), F.lit("$2")))
    return reduce(swap, ordered, body)
