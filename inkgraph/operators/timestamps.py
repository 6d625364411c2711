"""Problem 5: mixed timestamp formats and time zones into one unambiguous form.

Method.  A value is parsed by JVM-side expressions into a local date, a local clock time and what it says about its
zone (an offset, an abbreviation, a zone name, or nothing: then its agency's zone).  The offsets of every zone are laid
out as intervals of *local* time and exploded by year; parsed local times are joined as of those intervals on (zone,
year).  Two matching intervals mean that the time exists twice, none that it never existed, one gives the offset.

Scale.  One scan, no shuffle, the parsed values cut into a checkpoint.  The (zone, year) pairs in use are taken from it by a
map-side combined ``distinct``; the intervals of each pair are worked out where the pair is, so nothing is collected and any
number of zone names, junk ones too, may occur.  Only names of the zone database get a row, so the table has at most as many
rows as zones x 2,000 years; it is counted, and broadcast up to ``BROADCAST_ROWS`` rows, else joined by shuffle with the same
result.  No Python touches the values themselves.

Edge cases: null, blank and junk values, impossible dates (13th month, 30 February) and clocks (25:00, 13:05 pm), unknown
zone names and values without any zone give ``instant`` null with ``status`` ``unparsed`` / ``no_zone``; local times that
exist twice or never give ``ambiguous`` / ``nonexistent``.  Dates without a clock are not shifted and keep their
precision.  Fractions are cut off, not rounded.  Repeated rows are repeated in the result.  Years from 1000 to 2999 are
resolved, by the zone's rules of that year (local mean time before its first rule, its last rule after the last change);
other years are ``unparsed``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.session import cut, ship

#: Rows of the interval table (about 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 200_000

#: Offsets in minutes of zone abbreviations in general use (fixed values).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "CET": 60, "WEST": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180,
}

CLOCK = r"(?:^|[\sT,–—-])(\d{1,2})[:.hH](\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(?:([aApP])\.?\s?[mM]\.?)?[,;]?$"
HOURS = r"(?:^|[\sT,–—-])(\d{2})(\d{2})\s*(?:[hH]rs?\.?|[hH]ours)?$"
COMPACT = r"T(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?$"
BARE_HOUR = r"(?:^|[\s,])(\d{1,2})\s*([aApP])\.?\s?[mM]\.?[,;]?$"
WORD_CLOCK = r"(?i)(?:^|[\s,])(?:12\s+)?(noon|midday|midnight)$"
WEEKDAY = r"(?i)^(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)[a-z]*\.?,?\s+"
MONTHS = "january february march april may june july august september october november december".split()
MONTH = r"((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[A-Za-z]*)"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that matches, as an array from one evaluation; else null."""
    marks = "\u0001".join(f"${i}" for i in range(1, n + 1))
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, r"^[\s\S]*?(?:" + pattern + ")[\\s\\S]*$", marks), "\u0001", -1))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(F.length(low).between(3, len(m)) & F.lit(m).startswith(low) | (low == "sept" if m == "september" else F.lit(False)), F.lit(i)) for i, m in enumerate(MONTHS, 1)])


@lru_cache(maxsize=4096)
def year_intervals(name: str, year: int) -> tuple[tuple[datetime, datetime, int], ...]:
    """Intervals of local time that touch a local year of an IANA zone, with their offset in seconds.

    Offsets are probed every six days and each change is bisected to the second.
    """
    zone, step = ZoneInfo(name), timedelta(days=6)

    def offset(utc: datetime) -> int:
        return int(utc.replace(tzinfo=timezone.utc).astimezone(zone).utcoffset().total_seconds())

    at, last = datetime(year, 1, 1) - timedelta(days=31), datetime(year, 12, 31) + timedelta(days=32)
    spans = [(at, offset(at))]
    while at < last:
        if (then := offset(at + step)) != spans[-1][1]:
            k = bisect.bisect_left(range(int(step.total_seconds()) + 1), True, key=lambda s, at=at, now=spans[-1][1]: offset(at + timedelta(seconds=s)) != now)
            spans.append((at + timedelta(seconds=k), then))
        at += step
    ends = [s for s, _ in spans[1:]] + [last]
    lo, hi = datetime(year, 1, 1), datetime(year, 12, 31) + timedelta(days=1)
    local = ((s + timedelta(seconds=o), e + timedelta(seconds=o), o) for (s, o), e in zip(spans, ends, strict=True))
    return tuple(x for x in local if x[0] < hi and x[1] > lo)


def zone_intervals(zones: list[str], years: tuple[int, int]) -> list[tuple[str, int, list[tuple[datetime, datetime, int]]]]:
    """(zone, local year, its intervals) of the zones among ``zones`` that the zone database has."""
    return [(z, y, list(year_intervals(z, y))) for z in sorted(set(zones) & available_timezones()) for y in range(years[0], years[1] + 1)]


def interval_table(used: DataFrame) -> DataFrame:
    """(_zone, _year, lo, hi, off): the intervals exploded for the pairs (_zone, _year) in use; unknown zones have none."""
    ship(used.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = available_timezones()
        for pdf in batches:
            out = [(z, y, *x) for z, y in zip(pdf["_zone"], pdf["_year"], strict=True) if z in known for x in year_intervals(z, int(y))]
            yield pd.DataFrame([(z, y, lo.isoformat(), hi.isoformat(), off) for z, y, lo, hi, off in out], columns=["_zone", "_year", "lo", "hi", "off"])

    made = used.where("_zone is not null and _year is not null").select("_zone", "_year").distinct().mapInPandas(rows, "_zone string, _year int, lo string, hi string, off int")
    return made.select("_zone", "_year", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"), "off")


def parse(df: DataFrame, text: str, date_order: str, day: str | None = None) -> DataFrame:
    """Adds ``_date`` / ``_clock`` parts: y, mo, d, local (timestamp without zone), utc_s, zone, off, precision.

    ``day``: a date column on which values with a clock alone fall; then the values are read as clocks.
    """
    t = F.trim(F.regexp_replace(F.col(text), r"[\s  ]+", " "))
    df = df.withColumn("_t", F.regexp_replace(t, WEEKDAY, ""))
    # what the value says of its zone
    named = F.nullif(F.regexp_extract("_t", r"\[([A-Za-z]+(?:/[A-Za-z_+-]+)+)\]$", 1), F.lit(""))
    gmt = F.nullif(F.regexp_extract("_t", r"(?i)\s?(?:GMT|UTC)\s?([+-]\d{1,2}(?::?\d{2})?)$", 1), F.lit(""))
    num = F.nullif(F.regexp_extract("_t", r"(?:\d[:.hH]\d{2}|T\d{4,6}|\d{4} ?[hH]rs?|[aApP]\.?\s?[mM]\.?)(?:[:.]\d+)*(?:\s?(?:[aApP]\.?\s?[mM]\.?|[hH]rs))?\s?([+-]\d{2}:?\d{2})$", 1), F.lit(""))
    abbr = F.nullif(F.regexp_extract("_t", r"(?:[\d.a-zA-Z]\s+|(?<=\d)|(?<=[mM]\.?)|(?<=hrs))(" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + ")$", 1), F.lit(""))
    df = df.withColumns({"_named": named, "_num": F.coalesce(gmt, num)})
    df = df.withColumn("_abbr", F.when(F.col("_named").isNull() & F.col("_num").isNull(), abbr))
    sign = F.when(F.col("_num").startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace("_num", r"[^\d]", "")
    hh = _int(F.when(F.length(digits) <= 2, digits).otherwise(F.expr("left(regexp_replace(_num,'[^0-9]',''), length(regexp_replace(_num,'[^0-9]',''))-2)")))
    mm = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(_int(F.right(digits, F.lit(2))))
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    off = F.coalesce(F.when(F.col("_num").isNotNull() & (hh <= 14) & (mm < 60), sign * (hh * 60 + mm)), table[F.col("_abbr")]) * 60
    bare = F.trim(F.regexp_replace("_t", r"(?i)\s?(?:\[[A-Za-z_/+-]+\]|(?:GMT|UTC)\s?[+-]\d{1,2}(?::?\d{2})?)$", ""))
    bare = F.when(F.col("_named").isNotNull() | gmt.isNotNull(), bare).when(F.col("_num").isNotNull(), F.trim(F.regexp_replace("_t", r"\s?[+-]\d{2}:?\d{2}$", ""))).when(F.col("_abbr").isNotNull(), F.trim(F.expr("left(_t, length(_t)-length(_abbr))"))).otherwise(F.col("_t"))
    df = df.withColumns({"_off": off, "_b": bare})
    # the clock
    b = F.col("_b")
    df = df.withColumns({"_c1": _groups(b, CLOCK, 4), "_c2": _groups(b, COMPACT, 3)})
    df = df.withColumns({
        "_c3": F.when(F.col("_c1").isNull() & F.col("_c2").isNull() & b.rlike(r"(?i)\d{4}\s*(?:hrs?\.?|hours)$" if day is None else HOURS), _groups(b, HOURS, 2)),
        "_c4": F.lower(F.nullif(F.regexp_extract(b, WORD_CLOCK, 1), F.lit(""))),
        "_c5": F.when(F.col("_c1").isNull(), _groups(b, BARE_HOUR, 2)) if day is not None else F.lit(None).cast("array<string>"),
    })
    h, half = _int(F.coalesce(F.col("_c1")[0], F.col("_c5")[0])), F.lower(F.coalesce(F.nullif(F.col("_c1")[3], F.lit("")), F.col("_c5")[1]))
    h24 = F.when(half.isNull(), F.when(h < 24, h)).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    hour = F.when(F.col("_c1").isNotNull() | F.col("_c5").isNotNull(), h24).when(F.col("_c2").isNotNull(), _int(F.col("_c2")[0])).when(F.col("_c3").isNotNull(), _int(F.col("_c3")[0])).when(F.col("_c4") == "midnight", F.lit(0)).when(F.col("_c4").isNotNull(), F.lit(12))
    minute = F.coalesce(_int(F.col("_c1")[1]), _int(F.col("_c2")[1]), _int(F.col("_c3")[1]), F.lit(0))
    second = F.coalesce(_int(F.col("_c1")[2]), _int(F.col("_c2")[2]), F.lit(0))
    clocked = F.col("_c1").isNotNull() | F.col("_c2").isNotNull() | F.col("_c3").isNotNull() | F.col("_c4").isNotNull() | F.col("_c5").isNotNull()
    df = df.withColumns({"_clocked": clocked, "_h": hour, "_mi": minute, "_s": second})
    null_int = F.lit(None).cast("int")
    if day is not None:
        whole = b.rlike(r"(?i)^(?:(?:at|around|about|approx\.?|ca\.?|by|circa)\s+)?(?:\d{1,2}[:.h]\d{2}(?::\d{2})?\s*(?:[ap]\.?\s?m\.?)?[,;]?|\d{4}\s*(?:hrs?\.?|hours)?|\d{1,2}\s*[ap]\.?\s?m\.?[,;]?|(?:12\s+)?(?:noon|midday|midnight))$")
        df = df.withColumns({"_clocked": F.col("_clocked") & whole, "_y": F.year(day), "_mo": F.month(day), "_d": F.dayofmonth(day), "_epoch": F.lit(None).cast("bigint")})
        df = df.withColumn("_p", F.when(F.col("_clocked"), F.lit("s")))
    else:
        date = F.when(F.col("_c4").isNotNull(), F.regexp_replace(b, WORD_CLOCK, "")).when(F.col("_c1").isNotNull(), F.regexp_replace(b, CLOCK, "")).when(F.col("_c2").isNotNull(), F.regexp_replace(b, COMPACT, "")).when(F.col("_c3").isNotNull(), F.regexp_replace(b, HOURS, "")).otherwise(b)
        date = F.regexp_replace(date, r"(?i)^(?:(?:the|on|in|year|of|since|during|by|about|around|circa|ca?\.?)\s+)+|[\s,T–—-]+$|(?:,?\s+at)$", "")
        df = df.withColumn("_dt", F.trim(F.regexp_replace(date, r"[\s,;]+$", "")))
        x = F.col("_dt")
        df = df.withColumns({
            "_d1": F.coalesce(_groups(x, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 3), _groups(x, r"^(\d{4})(\d{2})(\d{2})$", 3)),
            "_d2": _groups(x, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", 3),
            "_d3": _groups(x, r"^(\d{1,2})(?:st|nd|rd|th|\.)?(?:\s+of)?[\s-]+" + MONTH + r"\.?,?[\s-]+(\d{4})$", 3),
            "_d4": _groups(x, "^" + MONTH + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", 3),
            "_d5": _groups(x, r"^(\d{4})[-/.](\d{1,2})$", 2),
            "_d6": _groups(x, r"^(\d{1,2})[-/.](\d{4})$", 2),
            "_d7": _groups(x, "^" + MONTH + r"\.?,?(?:\s+of)?\s+(\d{4})$", 2),
            "_d8": _groups(x, r"^(\d{4})$", 1),
            "_epoch": F.when(F.col("_t").rlike(r"^\d{10}$"), F.col("_t").try_cast("bigint")).when(F.col("_t").rlike(r"^\d{13}$"), F.floor(F.col("_t").try_cast("bigint") / 1000)),
        })
        a, c = _int(F.col("_d2")[0]), _int(F.col("_d2")[1])
        mdy = F.when(F.col(date_order) == "mdy", True).when(F.col(date_order) == "dmy", False).when((a > 12) & (c <= 12), False).when((c > 12) & (a <= 12), True).when(a == c, True)
        y2 = _int(F.col("_d2")[2])
        y2 = F.when(F.length(F.col("_d2")[2]) == 2, y2 + 2000).otherwise(y2)
        year = F.coalesce(_int(F.col("_d1")[0]), y2, _int(F.col("_d3")[2]), _int(F.col("_d4")[2]), _int(F.col("_d5")[0]), _int(F.col("_d6")[1]), _int(F.col("_d7")[1]), _int(F.col("_d8")[0]))
        month = F.coalesce(_int(F.col("_d1")[1]), F.when(mdy, a).when(~mdy, c), _month(F.col("_d3")[1]), _month(F.col("_d4")[0]), _int(F.col("_d5")[1]), _int(F.col("_d6")[0]), _month(F.col("_d7")[0]))
        dom = F.coalesce(_int(F.col("_d1")[2]), F.when(mdy, c).when(~mdy, a), _int(F.col("_d3")[0]), _int(F.col("_d4")[1]))
        full = F.col("_d1").isNotNull() | F.col("_d2").isNotNull() | F.col("_d3").isNotNull() | F.col("_d4").isNotNull()
        monthly = F.col("_d5").isNotNull() | F.col("_d6").isNotNull() | F.col("_d7").isNotNull()
        p = F.when(F.col("_epoch").isNotNull(), F.lit("e")).when(full, F.when(F.col("_clocked"), "s").otherwise("d")).when(F.col("_clocked"), F.lit(None)).when(monthly, F.lit("m")).when(F.col("_d8").isNotNull(), F.lit("y"))
        df = df.withColumns({"_y": year, "_mo": F.coalesce(month, null_int), "_d": F.coalesce(dom, null_int), "_p": p})
    sane = F.col("_y").between(1000, 2999)
    df = df.withColumn("_local", F.when(sane & F.col("_p").isin("s", "d"), F.try_make_timestamp_ntz(F.col("_y"), F.col("_mo"), F.col("_d"), F.when(F.col("_p") == "d", 0).otherwise(F.col("_h")), F.when(F.col("_p") == "d", 0).otherwise(F.col("_mi")), F.when(F.col("_p") == "d", 0).otherwise(F.col("_s")).cast("decimal(8,6)"))))
    return df


def normalize(values: DataFrame, text: str, zone: str, date_order: str, day: str | None = None) -> DataFrame:
    """``values`` with ``instant`` and ``status`` (ok, ambiguous, nonexistent, no_zone, unparsed) of the column ``text``.

    ``zone``: the column with the IANA zone for values that name none; ``day``: see :func:`parse`.
    """
    keep = values.columns
    # a date alone and a value with an offset of its own need no zone
    own = F.when((F.col("_p") == "s") & F.col("_off").isNull() & F.col("_local").isNotNull(), F.coalesce(F.col("_named"), F.col(zone)))
    # Cut here: carried on into the join, the layers of the parse cost the optimizer seconds and the driver its heap.
    parsed = cut(parse(values, text, date_order, day).select(*keep, "_p", "_local", "_off", "_named", "_epoch", "_y", "_mo"))
    parsed = parsed.withColumn("_zone", own).withColumn("_year", F.when(F.col("_zone").isNotNull(), F.year("_local")))
    spans = interval_table(parsed).groupBy("_zone", "_year").agg(F.collect_list(F.struct("lo", "hi", "off")).alias("_spans"))  # a few intervals a year
    spans = cut(spans)
    joined = parsed.join(F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans, ["_zone", "_year"], "left")
    hits = F.filter("_spans", lambda s: (s["lo"] <= F.col("_local")) & (F.col("_local") < s["hi"]))
    joined = joined.withColumn("_hits", hits)
    off = F.coalesce(F.col("_off"), F.when(F.size("_hits") == 1, F.col("_hits")[0]["off"]))
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _local)")
    seconds = F.when(F.col("_p") == "e", F.col("_epoch")).when(F.col("_p") == "s", epoch - off)
    instant = F.when(seconds.isNotNull(), F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    instant = instant.when((F.col("_p") == "d") & F.col("_local").isNotNull(), F.date_format("_local", "yyyy-MM-dd")).when((F.col("_p") == "m") & F.col("_mo").between(1, 12) & F.col("_y").between(1000, 2999), F.format_string("%04d-%02d", "_y", "_mo")).when((F.col("_p") == "y") & F.col("_y").between(1000, 2999), F.format_string("%04d", "_y"))
    status = F.when(F.col("instant").isNotNull(), "ok").when((F.col("_p") != "s") | F.col("_p").isNull() | F.col("_local").isNull(), "unparsed").when(F.col("_spans").isNull(), "no_zone").when(F.size("_hits") > 1, "ambiguous").otherwise("nonexistent")
    return joined.withColumn("instant", instant).withColumn("status", status).select(*keep, "instant", "status")


def case_times(events: DataFrame, biographies: DataFrame, agencies: DataFrame) -> DataFrame:
    """(src, row_id, item_no, instant, status) of the three kinds of time values of a case file."""
    zones = F.broadcast(agencies.select("agency_code", "zone_id", "date_order"))  # a fixed reference list
    ev = events.select("id", "agency_code", "ts_raw", "time_raw", "case_date").join(zones, "agency_code", "left")
    bio = biographies.select("id", "agency_code", F.posexplode("segments").alias("item_no", "seg")).join(zones, "agency_code", "left")
    cols = ["src", "row_id", "item_no", "text"]
    a = ev.select(F.lit("case_events.ts_raw").alias("src"), F.col("id").alias("row_id"), F.lit(0).alias("item_no"), F.col("ts_raw").alias("text"), "zone_id", "date_order")
    c = bio.select(F.lit("victim_biographies.time_text").alias("src"), F.col("id").alias("row_id"), "item_no", F.col("seg.time_text").alias("text"), "zone_id", "date_order")
    b = ev.select(F.lit("case_events.time_raw").alias("src"), F.col("id").alias("row_id"), F.lit(0).alias("item_no"), F.col("time_raw").alias("text"), "zone_id", "date_order", "case_date")
    full = normalize(a.unionByName(c), "text", "zone_id", "date_order").select(*cols, "instant", "status")
    clock = normalize(b, "text", "zone_id", "date_order", "case_date").select(*cols, "instant", "status")
    return full.unionByName(clock)
