"""Problem 2: sentence boundaries across languages and scripts.

Method: character-property sentence-break rules.  Every character with the Unicode property Sentence_Break STerm or ATerm (the
terminators of all scripts) with the closing quotes and brackets (categories Pe and Pf) after it is a candidate
boundary; a candidate falls when the next word goes on in lower case, when the stop belongs to a number, an initial or
an abbreviation of the languages (some never end a sentence, some do before a capital), when it stands inside a quotation
or bracket, or when the closed quotation is taken up by its reporting clause.  Scripts that part sentences by spaces
(Thai, Lao, Khmer) break at spaces, but not inside a name.  Blank lines end units; a single line end without a mark ends
one where the line was not full, so that the break was not forced by the width.  A text's width is what most of its inner
line ends were broken at (:func:`width_of`).

Scale.  A projection: each row is worked on by itself in an Arrow batch, no shuffle; time is linear in the text (each
candidate looks at a bounded number of words before and after it, by offsets).

Edge cases: null and blank texts and items give no unit; runs of marks are one boundary; an unclosed quotation is ignored;
items of one record are read as one running text, so an item that stops in mid-sentence has no end of its own, and an
empty item is passed over; very long texts are read whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLANES = "".join(chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c <= 0xDFFF)
#: Terminators by character property; the ellipsis, which has none, may end a sentence too.
STRONG = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _PLANES))
STOPS = STRONG + "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _PLANES)) + "…"
IDEOGRAPHIC = "。！？｡"
#: Marks of exclamation and question after which a sentence may go on in lower case.
WEAK = "!?‼‽⁇⁈⁉"
CLOSERS = "\"'" + "".join(regex.findall(r"[\p{Pe}\p{Pf}]", _PLANES))
CANDIDATE = re.compile(f"([{re.escape(STOPS)}](?:\\s?[{re.escape(STOPS)}])*)([{re.escape(CLOSERS)}]*)")
#: Below this many characters a single full line shows the width of a page; wider ones need a second line.
PAGE = 120
PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‹": "›", "《": "》", "(": ")", "（": "）"}
QUOTES = frozenset("“«„「『‹\"")
NEXT = re.compile(r"\S")
TOKEN = re.compile(r"\S+")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
CJK = re.compile(r"[぀-ヿ一-鿿]")
SPACED = re.compile(r"[฀-๿຀-໿ក-៿]")
SPACED_GAP = re.compile(r"(?<=[฀-๿຀-໿ក-៿”\"])\s+(?=[฀-๿຀-໿ក-៿“\"])")

#: Abbreviations (without their stop, lower case) that never end a sentence: titles, ranks and words that lead on.
LEADING = frozenset("""
mr mrs ms mx dr drs prof rev hon messrs mme mlle lt col gen maj capt cpt cmdr sgt cpl pvt det insp ofc dep supt sra srta dra dña ing lic
hr fr frl hrn str nr ca bzw vgl sog usw inkl zzgl evtl ggf tel abs art bd
approx aprox cf pp vs viz no nos núm num fig figs vol vols ed eds op elem dept univ assn incl esp resp temp orig est ext cat
гр тов проф акад ул им стр рис см ср напр тыс млн д-р г-н г-жа
sig sigg dott avv prof. núm. pág pag págs av exc exma exmo
डॉ श्री पं प्रो कु د أ م ก.
""".split())  # fmt: skip
#: Stops of units, times and endings: they end a sentence where a capital follows.
CLOSING = frozenset("""
a.m p.m am pm hrs hr h min mins sec secs ft in lb lbs oz yd yds mi cm mm km m kg g mg ml l sq cu mph kph
etc al inc ltd co corp jr sr esq bros ave blvd rd st ln ct pl hwy pkwy apt ste
i.e e.g u.s u.k n.e n.w s.e s.w b.a m.a b.sc ph.d e.t.a d.c
г гг ч мин сек м см км кг п т.п т.д т.е н.э руб коп р
uds ud dcha izq cía s.a
jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun
""".split())  # fmt: skip
#: Spaced abbreviations of several letters that lead on (z. B., d. h., p. ex. ...).
SPACED_ABBREVIATION = re.compile(r"(?:\b(?:z|d|u|i|o|s|v)\.\s?(?:B|h|a|T|Ä|d|ä|U|R|o|u|E)|\bp\.\s?ex|\bp\.\s?ej|\bт\.\s?е|\bи\.\s?о|\bpor\s?ej)$")
MONTHS_DE = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Mär|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez)\b")
CLOCK_LEAD = re.compile(r"\W*(?:(?:at|by|around|about|from|since|until|near|approx\.?|a las?|às|à|um|gegen|vers|около|в)\s+)*\d{1,2}(?:[:.h]\d{2})?\s*(?:[ap]\.\s?m|hrs?|h|ч|uhr)\.?\W*", re.I)
CLOCK_NEXT = re.compile(r"\d{1,2}[:.]\d{2}\s*(?:[ap]\.?m|$|\s)|\d{4}\s?hrs", re.I)
TAIL = re.compile(r"[^\s(\[{“”„«»\"'‘’「」/]+$")
STREET = re.compile(r"\d+[A-Za-z]?,?\s+(?:[A-Z][\w'’]*\s+){1,4}$")
INITIAL_NEXT = re.compile(r"\s?\w\.")
INITIALS = re.compile(r"(?:\w\.)+\w")
SR_ARTICLE = re.compile(r"(?:^|\s)(?:el|al|del|los|un|o|ao|do|os|um)$")
LINE_END = re.compile(r"\n\s*")
THAI_MARKS = re.compile(r"[ัิ-ฺ็-๎]")
UNIT_NEXT = re.compile(r"(?:Unit|Apt|Suite|Ste|Flat|Floor|No|Rm|Room)\b|#")
REPORTING = re.compile(
    r"\s*(?:(?:[^\s.!?…\n“”«»]+|(?:[A-Z][a-z]{0,4}|[A-Z])\.)\s+){0,6}?(?:said|says|asked|asks|shouted|whispered|replied|answered|added|cried|called|yelled|muttered|insisted|repeated|explained|screamed|murmured|recalled|wrote|writes|used to say|told (?:me|us|him|her|them)|"
    r"dijo|preguntó|respondió|gritó|añadió|a dit|a répété|a demandé|dit|demanda|répondit|sagte|fragte|rief|antwortete|disse|perguntou|respondeu|gritou|сказала?|спросила?|ответила?|крикнула?|قال|قالت)\b(?!\s+(?:whether|if|to)\b)"
)
REPORTING_CJK = re.compile(r"[^。！？\n“「]{0,24}(?:说|問|问|答|道|喊|叫|告诉|言|尋|話|述|嘆|叹)")


def quote_spans(p: str) -> list[tuple[int, int]]:
    """Spans [open, close] of quotations and brackets in a paragraph, outermost ones, closed ones only."""
    spans, stack = [], []
    for i, c in enumerate(p):
        if stack and c == stack[-1][1]:
            start, _ = stack.pop()
            if not stack:
                spans.append((start, i))
            continue
        if c == '"':
            stack.append((i, '"'))
        elif c in PAIRS:
            stack.append((i, PAIRS[c]))
    if stack:  # something was never closed: take what closes without it
        spans = []
        for m in re.finditer(r"“[^“”]*”|«[^«»]*»|„[^„“]*“|「[^「」]*」|『[^『』]*』|\([^()]*\)|（[^（）]*）", p):
            if not spans or m.start() > spans[-1][1]:
                spans.append((m.start(), m.end() - 1))
    return spans


def words_before(p: str, at: int, n: int) -> str:
    """The text of the last ``n`` words before a place, with the space behind them."""
    i = at
    for _ in range(n):
        while i and p[i - 1].isspace():
            i -= 1
        while i and not p[i - 1].isspace():
            i -= 1
    return p[i:at]


def holds(p: str, start: int, pos: int, end: int, nxt: int) -> bool:
    """Whether the full stop at ``pos`` is no boundary, by what it belongs to.

    ``start``: of the sentence; ``end``: behind the stop; ``nxt``: the next character that is no space.
    """
    m = TAIL.search(words_before(p, pos, 1))
    word = m.group() if m else ""
    if not word:
        return False
    low = word.lower().rstrip(".")
    first = p[nxt : nxt + 1]
    at = pos - len(word)
    if SPACED_ABBREVIATION.search(p, max(0, pos - 16), pos):
        return True
    if len(word) == 1 and INITIAL_NEXT.match(p, end):  # z. T., d. h., J. R.
        return True
    if low in ("dr", "st", "ave", "rd", "ln", "ct", "blvd") and STREET.search(words_before(p, at, 5)):
        return bool(UNIT_NEXT.match(p, nxt))
    if low == "st" or low in ("apt", "ste"):
        return True
    if low in ("no", "nos"):
        return first == "#" or any(c.isdigit() for c in TOKEN.match(p, nxt).group()) if first else False
    if low == "sr" and SR_ARTICLE.search(words_before(p, at, 1).rstrip().lower()):
        return True
    if low in LEADING:
        return True
    if len(word) == 1 and word.isalpha() and word.isupper():
        return True
    if low in ("r", "г", "с") and word.islower() and not words_before(p, at, 1).rstrip()[-1:].isdigit():
        return True
    if low in CLOSING or INITIALS.fullmatch(word) or (len(word) == 1 and word.isalpha()):
        if CLOCK_LEAD.fullmatch(p, start, pos):
            return True
        return not (first.isupper() or first in "“«¿¡„「" or CLOCK_NEXT.match(p, nxt) or not (first.isalnum() or first in "([,;:-–—&/")) if first else False
    return word.isdigit() and len(word) <= 2 and MONTHS_DE.match(p, nxt) is not None


def paragraph_ends(p: str, width: int) -> list[int]:
    """Ends of the units of one paragraph; offsets in ``p``, which has no blank space at its end."""
    spans = quote_spans(p)
    ends: list[int] = []
    start = 0
    size = len(p)
    marks: list[tuple[int, str, re.Match | None]] = [(m.start(), "stop", m) for m in CANDIDATE.finditer(p)]
    line_start = 0
    for m in LINE_END.finditer(p):
        at = m.start()
        while at > line_start and p[at - 1].isspace():
            at -= 1
        word = TOKEN.match(p, m.end())
        full = at - line_start <= width < (at - line_start) + 1 + (len(word.group()) if word else 0)
        if not full:
            marks.append((at, "line", m))
        line_start = m.start() + 1
    if SPACED.search(p) is not None:
        marks += [(m.start(), "gap", m) for m in SPACED_GAP.finditer(p)]
    marks.sort(key=lambda x: x[0])
    inside = iter(spans + [(size + 1, size + 1)])
    lo, hi = next(inside)
    for pos, kind, m in marks:
        while hi < pos:
            lo, hi = next(inside)
        if pos < start:
            continue
        if kind == "line":
            if lo < pos < hi:
                continue
            nxt = p[m.end() : m.end() + 1]
            if not blank(p, start, pos) and (nxt.isupper() or nxt in "“«¿¡„「#" or not nxt.islower() and not nxt.isascii() and not CJK.match(nxt)):
                ends.append(pos)
                start = m.end()
            continue
        if kind == "gap":
            if lo < pos < hi:
                continue
            piece = p[start:pos].strip()
            if len(THAI_MARKS.sub("", piece)) <= 9 and not piece.endswith(tuple(STRONG)):
                continue
            ends.append(pos)
            start = m.end()
            continue
        stops, closers = m.group(1), m.group(2)
        end = m.end(2)
        found = NEXT.search(p, end)
        nxt = found.start() if found else size
        first, joined = p[nxt : nxt + 1], nxt == end  # joined: no space behind the mark
        if lo < pos < hi:
            if end - 1 < hi:  # inside a quotation or bracket
                continue
            # the quotation ends here with its own mark
            if p[lo] in "(（":
                continue
            if first and (first.islower() or first in ",;:—–-"):
                continue
            opening = blank(p, start, lo)
            if stops[0] in IDEOGRAPHIC or p[lo] in "「『" or CJK.match(first):
                if first and first in "とっ" or opening and REPORTING_CJK.match(p, nxt):
                    continue
            elif opening and REPORTING.match(p, end):
                continue
        else:
            if stops == "." and first and not closers:
                if joined:  # inside a number, an address or a word
                    continue
                if first.islower() or first in ",;:":
                    continue
                if holds(p, start, pos, end, nxt):
                    continue
            elif stops[0] in "….":
                if first and (first.islower() or first in ",;:" or joined or not (first.isupper() or first in "“«¿¡„([") and not first.isdigit()):
                    continue
            elif first and stops[0] in WEAK and (first.islower() or first in ",;:" or joined and first.isalnum()):
                continue
        ends.append(end)
        start = end
    if not blank(p, start, size):
        ends.append(size)
    return ends


def blank(p: str, start: int, end: int) -> bool:
    """Whether there is nothing but space between two places."""
    m = NEXT.search(p, start)
    return m is None or m.start() >= end


def width_of(lines: list[str]) -> int:
    """The width at which a text was broken into lines; -1 where it was not.

    A width w explains an inner line end (one with a line of text on both sides) when the line is not longer than w but
    would have been with the next word.  The width that explains most inner line ends holds if it explains at least two
    and half of them and if fewer than half as many lines of the text are longer.  A text whose longest line is not longer
    than ``PAGE`` was broken at that line.
    """
    sizes = [len(x.rstrip()) for x in lines]
    events: list[tuple[int, int]] = []
    inner = 0
    for i in range(len(lines) - 1):
        if sizes[i] and sizes[i + 1]:
            inner += 1
            events += [(sizes[i], 1), (sizes[i] + 1 + len(TOKEN.search(lines[i + 1]).group()), -1)]
    if not inner:
        return -1
    events.sort()
    ordered = sorted(sizes)
    longest = ordered[-1]
    best, now = (0, -1), 0
    for k, (at, step) in enumerate(events):
        now += step
        if step > 0 and (k + 1 == len(events) or events[k + 1][0] > at or events[k + 1][1] < 0):
            over = len(ordered) - bisect_right(ordered, at)
            if now >= 2 and 2 * now >= inner and 2 * over <= now:
                best = max(best, (now, at))
    if longest <= PAGE:
        explains = sum(step for at, step in events if at <= longest)
        best = max(best, (explains, longest))
    return best[1]


def sentence_ends(text: str) -> list[int]:
    """The end of each unit of a text, in characters."""
    out: list[int] = []
    if not text or not text.strip():
        return out
    width = width_of(text.split("\n"))
    at = 0
    for piece in re.split(f"({BLANK.pattern})", text):
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            body = piece.strip()
            out += [at + lead + e for e in paragraph_ends(body, width)]
        at += len(piece)
    return out


def item_ends(items: list[str | None]) -> list[tuple[int, int]]:
    """(item, end within it) of the units of consecutive items of one running text."""
    joined, starts = [], []
    at = 0
    for i, t in enumerate(items):
        if t is None or not t.strip():
            continue
        starts.append((at, i, len(t)))
        joined.append(t.replace("\n", " "))
        at += len(t) + 1
    text = " ".join(joined)
    body = text.rstrip()
    found = set(paragraph_ends(body, -1)) if body.strip() else set()
    for (s, _, n), nxt in zip(starts, starts[1:], strict=False):  # an item that ends without a mark and is not carried on
        a, b = text[s : s + n].rstrip(), text[nxt[0] : nxt[0] + nxt[2]].lstrip()
        if a[-1:].isalnum() and (b[:1].isupper() or b[:1] in "“«¿¡„") and not SPACED.search(a):
            found.add(s + len(a))
    out = []
    k = 0
    for e in sorted(found):
        while k + 1 < len(starts) and starts[k + 1][0] < e:
            k += 1
        s, i, n = starts[k]
        if e - s <= n:
            out.append((i, e - s))
    return out


def find(narratives: DataFrame, biographies: DataFrame) -> DataFrame:
    """(src, row_id, item_no, end_char) of every sentence unit of the narratives (scans apart) and biography items."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, 0, e) for r, t in zip(pdf["row_id"], pdf["text"], strict=True) for e in sentence_ends(t)]
            yield pd.DataFrame(rows, columns=["row_id", "item_no", "end_char"])

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, i, e) for r, ts in zip(pdf["row_id"], pdf["texts"], strict=True) for i, e in item_ends(list(ts))]
            yield pd.DataFrame(rows, columns=["row_id", "item_no", "end_char"])

    schema = "row_id bigint, item_no int, end_char int"
    a = narratives.where("intake is distinct from 'scan'").where(F.col("text").isNotNull()).select(F.col("id").alias("row_id"), "text").mapInPandas(texts, schema)
    b = biographies.where(F.col("sentences").isNotNull()).select(F.col("id").alias("row_id"), F.transform("sentences", lambda s: s["text"]).alias("texts")).mapInPandas(items, schema)
    return a.select(F.lit("narratives").alias("src"), "*").unionByName(b.select(F.lit("victim_biographies").alias("src"), "*"))
