"""Events and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import fixed
from inkgraph.operators.ordered import following


def candidates(sents: DataFrame) -> DataFrame:
    """Sentences with a clock time or an event verb, with the time and the category of the event."""
    low = F.lower("text")
    cat = F.when(low.contains("arrived"), "arrival").when(low.contains("reported"), "report").when(low.contains("observed"), "observation").when(low.contains("pronounced"), "pronouncement").otherwise("unknown")
    clock = F.regexp_extract("text", fixed.CLOCK, 0)
    return sents.where(F.col("text").rlike(fixed.CLOCK) | F.col("text").rlike(fixed.EVENT_VERBS)).withColumns({"time_raw": F.when(clock != "", clock), "category": cat})


def clock_to_iso(raw: Column, day: Column, strict: bool = False) -> Column:
    """A 12-hour clock time as an ISO local time on ``day``; null when it is none.

    ``strict`` takes only forms without dots in the meridiem.
    """
    pattern = r"(?i)\b(\d{1,2})[:.](\d{2})\s*([ap])m\b" if strict else r"(?i)\b(\d{1,2})[:.](\d{2})\s*([ap])\.?\s*m"
    h, m, p = F.regexp_extract(raw, pattern, 1).try_cast("int"), F.regexp_extract(raw, pattern, 2).try_cast("int"), F.lower(F.regexp_extract(raw, pattern, 3))
    hour = h % 12 + F.when(p == "p", 12).otherwise(0)
    return F.when(h.between(1, 12) & m.between(0, 59) & day.isNotNull(), F.format_string("%sT%02d:%02d:00", day.cast("string"), hour, m))


def participants(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(event id, participant): distinct names of involved persons, bodies and things."""
    ids = events.select(F.col("id").alias("event"), F.explode("entities_involved").alias("id"))
    who = entities.where(F.upper("entity_type").isin(fixed.PARTICIPANT_LABELS) & (F.trim("entity_name") != "")).select("id", F.trim("entity_name").alias("participant"))
    return ids.join(who, "id").select("event", "participant").distinct()


def locations(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(event id, location): the place, the place words that the description says, and the involved entities that are places."""
    place = F.lower(F.trim("place"))
    low = F.lower("description")
    words = F.filter(F.array(*map(F.lit, fixed.PLACE_WORDS)), lambda w: F.contains(low, w))
    allp = F.array_distinct(F.concat(F.when(place != "", F.array(place)).otherwise(F.array().cast("array<string>")), F.coalesce(words, F.array().cast("array<string>"))))
    said = events.select(F.col("id").alias("event"), F.explode(allp).alias("location"))
    where = entities.where((F.upper("entity_type") == "LOC") & (F.trim("entity_name") != "")).select("id", F.lower(F.trim("entity_name")).alias("location"))
    own = events.select(F.col("id").alias("event"), F.explode("entities_involved").alias("id")).join(where, "id").select("event", "location")
    return said.union(own).distinct()


def number_in_doc(events: DataFrame, keys: list[str], order: list[str], out: str = "event_no") -> DataFrame:
    return events.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))  # events of one document


def event_id(doc_name: Column, number: Column) -> Column:
    return F.concat(doc_name, F.lit("_EV"), number.cast("string"))


def before_edges(events: DataFrame, case: str = "case_id", at: str = "time_resolved", ident: str = "id") -> DataFrame:
    """(case, source, target): each timed event BEFORE the next of its case; ties keep the order of ids.

    The order is windowed by day, and days are chained, so a case with a third of all events stays spread out.
    """
    timed = events.where(F.col(at).isNotNull())
    nxt = following(timed, [case], F.substring(at, 1, 10), [at, ident], [ident])
    return nxt.where(F.col("following").isNotNull()).select(case, F.col(ident).alias("source_event"), F.col(f"following.{ident}").alias("target_event"))
