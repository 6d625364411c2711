"""Column functions that normalise text; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgraph.functions import fixed


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def narrative(c: Column) -> Column:
    """One line of text: header line off, misread heading mended once, degree signs and slashes made even."""
    c = F.regexp_replace(c, r"(?im)^REPORTING OFFICER['’]S NARRATIVE[^\n]*$", "")
    c = squeeze(c)
    c = F.regexp_replace(c, r"(^|[^R])EPORTING", "$1REPORTING")
    c = F.replace(c, F.lit("º"), F.lit("°"))
    return F.regexp_replace(c, r"\s*/\s*", " / ")


def expand(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), fixed.ABBREVIATIONS, c)


def expand_tight(c: Column) -> Column:
    """Abbreviations that are left in unified sentences, written out."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), fixed.TIGHT_ABBREVIATIONS, c)


def biography(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def interview(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n{2,}", "\n\n")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def ner_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_"))


def coref_norm(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9 ]", "")
    return F.replace(F.regexp_replace(c, r" +", " "), F.lit(" "), F.lit("_"))


def cluster_norm(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def graph_norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def entity_id(c: Column, prefix: str = "ENT_") -> Column:
    return F.concat(F.lit(prefix), F.replace(graph_norm(c), F.lit(" "), F.lit("_")))


def time_id(iso: Column) -> Column:
    return F.concat(F.lit("TIME_"), F.regexp_replace(iso, "[:T-]", ""))


def refine_norm(c: Column) -> Column:
    return F.coalesce(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("unknown"))


def word_count(c: Column) -> Column:
    return F.when(squeeze(c) == "", 0).otherwise(F.size(F.split(squeeze(c), " ")))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(c) * 1.2)).cast("bigint")


def within_budget(c: Column, budget: int) -> Column:
    """The text cut to a token budget, at least one word, marked where it was cut."""
    est, words = token_estimate(c), F.split(squeeze(c), " ")
    keep = F.greatest(F.lit(1), F.floor(F.lit(budget) / est * word_count(c))).cast("int")
    return F.when(est <= budget, squeeze(c)).otherwise(F.concat(F.array_join(F.slice(words, 1, keep), " "), F.lit("...")))


def absolute_link(href: Column, scheme_host: Column) -> Column:
    """A link made absolute on a page at the root of ``scheme_host``; null for what is no web address."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    host_only = F.regexp_replace(scheme_host, r"^([a-z]+:)//.*$", "$1")
    full = F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(host_only, h)).when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None).when(h.startswith("/"), F.concat(scheme_host, h)).otherwise(F.concat(scheme_host, F.lit("/"), h))
    return F.when((F.trim(href) != "") & (h != ""), full)


def unfenced(c: Column) -> Column:
    """What stands inside a code fence, or the text itself."""
    t = F.trim(c)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))).otherwise(t)


def section_title(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in fixed.SECTION_TITLES.items() for x in kv])
    return F.coalesce(known[key], F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def doc_type_of(file_name: Column) -> Column:
    n = F.lower(file_name)
    return F.when(n.contains("incidentreport") | n.contains("narrative"), "narrative").when(n.startswith("bio_"), "biography").when(n.startswith("interview_"), "interview")


def first_line(c: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
