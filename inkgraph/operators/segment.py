"""Texts into segments, paragraphs, turns and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import fixed, text

MARK = "\u0001"


def segments(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, seg_idx, time, text): a marker of time or role opens a segment and is part of it."""
    parts = F.split(F.regexp_replace(text.expand(text.narrative(F.col(body))), fixed.SEGMENT, MARK + "$1"), MARK)
    out = df.select(key, F.posexplode(parts).alias("seg_idx", "raw"))
    head = F.regexp_extract("raw", "(?iu)^" + fixed.SEGMENT[5:], 1)
    clock = F.regexp_extract(head, fixed.CLOCK, 0)
    return out.select(key, "seg_idx", F.when(clock != "", clock).alias("time"), F.trim("raw").alias("text")).where("text != ''")


def paragraphs(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, par_idx, text): blank-line separated, inner lines joined."""
    parts = F.split(text.biography(F.col(body)), r"\n\s*\n")
    return df.select(key, F.posexplode(parts).alias("par_idx", "raw")).select(key, "par_idx", text.squeeze(F.col("raw")).alias("text")).where("text != ''")


def header(body: Column) -> Column:
    """(title, header_time): the first two lines with text."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.get(lines, F.lit(0)).alias("title"), F.get(lines, F.lit(1)).alias("header_time"))


def interview_body(c: Column) -> Column:
    """What follows the header of an interview: its first line, and the second where it has text."""
    return F.trim(F.regexp_replace(c, r"^[^\n]*(\n|$)([ \t]*[^ \t\n][^\n]*(\n|$))?", ""))


def colon_turns(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, turn, speaker, text): a line with a colon opens a turn, other lines go on with it; before the first: NARRATOR."""
    lines = df.select(key, F.posexplode(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line != ''")
    opens = F.col("line").rlike("^[^:]+:")
    w = Window.partitionBy(key).orderBy("pos")  # the lines of one document
    lines = lines.withColumn("turn", F.sum(opens.cast("int")).over(w)).withColumn("speaker", F.when(opens, F.trim(F.regexp_extract("line", "^([^:]+):", 1)))).withColumn("said", F.when(opens, F.trim(F.regexp_replace("line", "^[^:]+:", ""))).otherwise(F.col("line")))
    out = lines.groupBy(key, "turn").agg(F.coalesce(F.max("speaker"), F.lit("NARRATOR")).alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("text"))
    return out.withColumn("text", F.trim("text")).where("text != ''")


def sentences(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, sent_idx, text) at sentence-ending marks followed by space."""
    parts = F.split(F.regexp_replace(text.squeeze(F.col(body)), r"([.!?])\s+", "$1" + MARK), MARK)
    return df.select(*keys, F.posexplode(parts).alias("sent_idx", "text")).where("text != ''")


def sentence_array(body: Column, guard: bool = True) -> Column:
    """The sentences of a text as an array; ``guard``: a stop of a listed abbreviation ends none."""
    t = text.squeeze(body)
    if guard:
        t = F.regexp_replace(t, r"\b(" + "|".join(x.replace(".", r"\.") for x in fixed.STOPPED) + r")\.", "$1\u0002")
    parts = F.split(F.regexp_replace(t, r"([.!?])\s+", "$1" + MARK), MARK)
    return F.filter(F.transform(parts, lambda x: F.replace(x, F.lit("\u0002"), F.lit("."))), lambda x: x != "")


def flags(c: Column) -> dict[str, Column]:
    return {"has_time": c.rlike(fixed.CLOCK), "has_actor": c.rlike(fixed.ACTOR), "has_env": c.rlike(fixed.SURROUNDINGS)}


def _short(t: Column) -> Column:
    return (F.size(F.split(t, " ")) < 3) & ~t.rlike("[.!?]$")


def merge_fragments(sents: Column) -> Column:
    """An array of sentences where one of fewer than three words without an end mark goes to the next; each merge takes two."""
    return F.transform(merge_flagged(F.transform(sents, lambda s: F.struct(s.alias("text"), *[F.lit(False).alias(k) for k in ("has_time", "has_actor", "has_env")]))), lambda s: s["text"])


def merge_flagged(sents: Column) -> Column:
    """The same over structs (text, has_time, has_actor, has_env); a merged sentence has the flags of both."""
    names = ("has_time", "has_actor", "has_env")
    kind = "struct<text:string,has_time:boolean,has_actor:boolean,has_env:boolean>"
    none = F.lit(None).cast(kind)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), none.alias("held"))
    joined = lambda a, b: F.struct(F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), *[(a[n] | b[n]).alias(n) for n in names])
    step = lambda a, s: F.when(a["held"].isNotNull(), F.struct(F.array_append(a["done"], joined(a["held"], s)).alias("done"), none.alias("held"))).when(_short(s["text"]), F.struct(a["done"].alias("done"), s.alias("held"))).otherwise(F.struct(F.array_append(a["done"], s).alias("done"), none.alias("held")))
    return F.aggregate(sents, start, step, lambda a: F.when(a["held"].isNotNull(), F.array_append(a["done"], a["held"])).otherwise(a["done"]))


def sentence_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("sentence_id", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))  # sentences of one document


def gazetteer(df: DataFrame, key: str, body: str, phrases: list[tuple[str, str]] = fixed.GAZETTEER) -> DataFrame:
    """(key, phrase, label, n): mentions of listed phrases, the longest first, not overlapping."""
    ordered = sorted(phrases, key=lambda p: -len(p[0]))
    pattern = r"\b(" + "|".join(p for p, _ in ordered) + r")\b"
    labels = F.create_map(*[F.lit(x) for p in phrases for x in p])
    hits = df.select(key, F.explode(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(1))).alias("phrase"))
    return hits.groupBy(key, "phrase").agg(F.count("*").alias("n")).withColumn("label", labels[F.col("phrase")])
