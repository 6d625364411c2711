"""Replies of summarising models: both layouts of sections, and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import text

NEW = "overview string, content_type string, sections map<string,array<string>>"
OLD = "overview string, key_sections array<string>, highlights array<string>, recommendations array<string>"


def summary(payload: Column) -> Column:
    """(overview, content_type, sections) of a reply; the older layout's lists become sections; null for bad JSON."""
    new, old = F.from_json(text.unfenced(payload), NEW), F.from_json(text.unfenced(payload), OLD)
    empty = F.array().cast("array<string>")
    made = F.create_map(*[x for k in ("key_sections", "highlights", "recommendations") for x in (F.lit(k), F.coalesce(old[k], empty))])
    kept = F.map_filter(F.coalesce(new["sections"], made), lambda _, v: v.isNotNull() & (F.size(v) > 0))
    return F.when(new["overview"].isNotNull(), F.struct(new["overview"].alias("overview"), F.coalesce(new["content_type"], F.lit("website")).alias("content_type"), kept.alias("sections")))


def report(summaries: DataFrame, key: str, column: str) -> DataFrame:
    """(key, section, idx, line): the lines of a report, empty sections left out."""
    s = summaries.select(key, F.explode(F.col(column)["sections"]).alias("k", "lines"))
    return s.select(key, text.section_title(F.col("k")).alias("section"), F.posexplode("lines").alias("idx", "line"))


def metrics_lines(analysis: DataFrame, key: str = "site") -> DataFrame:
    """(key, section, idx, line): the lines of a crawl's metrics in a report."""
    n = lambda c: F.col(c).cast("string")
    words = F.coalesce(F.nullif(F.array_join(F.slice("keywords", 1, 8), ", "), F.lit("")), F.lit("n/a"))
    lines = F.array(F.concat(F.lit("Pages crawled: "), n("total_pages")), F.concat(F.lit("Internal links: "), n("internal_links")), F.concat(F.lit("External links: "), n("external_links")), F.concat(F.lit("Top keywords: "), words), F.concat(F.lit("CTA links detected: "), F.size("ctas").cast("string")))
    return analysis.select(key, F.lit("Crawl Metrics").alias("section"), F.posexplode(lines).alias("idx", "line"))


def file_name(overview: Column, url: Column) -> Column:
    """A safe name of a report: the first thirty characters of its overview, else its address, signs as hyphens."""
    base = F.coalesce(F.nullif(F.trim(F.substring(overview, 1, 30)), F.lit("")), F.nullif(url, F.lit("")), F.lit("summary"))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}]", "-"), F.lit("-")), F.lit("")), F.lit("summary"))
