"""Problem 6: personal information inside free text.

Method: anchor expansion.  One Aho-Corasick automaton finds the anchors with their places: at-signs and their spelled-out
forms, dialling signs, groups of digits, identifier cues (licence, passport, number ...) and street kinds.  Deterministic
local parsers start at each anchor, expand it to its bounds within a window of whole words and validate it: an address part
needs both a local part and a dotted domain, a telephone number its groups, an identity number its shape, no evidence cue
before it and, where it is bare digits, an identifier cue shortly before; a street address its house number and street in
the order of the language.  Names are anchored by a lexicon that the corpus itself gives: words that follow titles and
ranks, and words that stand with those as first name and surname, judged by the share of their occurrences in such places;
the local parser adds initials, suffixes and parts broken by a line end, and leaves titles and possessives out.

Scale.  Two Python passes over Arrow batches without a shuffle of text.  The first counts words in name places per batch,
so that only counts of distinct words are shuffled (map-side combined).  The lexicon is broadcast only while it is below
``MAX_LEXICON`` words, which is counted first; beyond that each document gets, by a join on all words that its parser may
look up, the ones that the lexicon has, with the same result.  Documents are rows of their own, so hot sources or cases make
no hot task.  Windows are merged, so time is linear in the text.

Edge cases: null and blank texts give no spans; spans never overlap (an address or e-mail wins over a name inside it);
each repeat is a span of its own; very long texts are worked on whole; repeated rows give repeated spans under their ids;
extra columns are ignored; an empty corpus gives an empty lexicon and only the formal kinds are found.  By definition the
part of an e-mail address before its at-sign has at most 64 characters, a telephone number 7 to 15 digits, and a street
address at most six words before and twelve behind its street kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.session import cut

MAX_LEXICON = 400_000
MIN_SHARE = 0.1

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽА-ЯЁІЇЄҐ"
BREAK = r"(?:[-‐¬­]\n)"
WORD = rf"[{UPPER}][\ẁ-ͯ]*(?:(?:[’'-]|{BREAK})[^\W\d_][\ẁ-ͯ]*)*"
TOKEN = re.compile(rf"R/[OI]s?\b|{WORD}")
SPLIT = re.compile(rf"(R/[OI]s?\b|{WORD})")
TITLES = frozenset("""mr mrs ms miss mx dr prof rev officer ofc off deputy dep sheriff sergeant sgt detective det inspector insp lieutenant lt captain capt chief
corporal cpl trooper agent major colonel constable commander investigator judge r/o r/i r/os r/is mister madam coroner nurse attorney
sr sra srta don doña dra dña señor señora hr hrn herr fr frau m mme mlle monsieur madame me senhor senhora свидетель свидетельница господин госпожа гражданин гражданка""".split())  # fmt: skip
#: Words that open sentences after a title-like stop or stand in names of places and bodies.
NEVER = frozenset("""the a an in on at of and or but is was did do does has had who what where when why how it its this that these those there i we you he she they my our your his her their
street avenue road lane drive court boulevard blvd ave rd st ln ct way place terrace unit apt suite route highway north south east west old new upper lower
county city town department office center centre school college company bank hardware supply services control medical community elementary towing savings animal
january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
report case page exhibit item tag badge license dispatch csu eta no nos sr jr dr mr ms mrs inc llc ltd co corp usa uk u.s vs am pm
la el los las le les der die das un une una o os as um uma le il und et y e de du des da do dos das von van per for from with after before under if then not nothing neighbors outside get three some by friends money mail contact participants location
uh uhh um uhm er erm eh ehm hm hmm mm mmm ah oh yes según segun selon laut
who’s it’s rain humidity tire blood-like its friendly responding supplement scene narrative statement continued""".split())  # fmt: skip

EMAIL_ANCHOR = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)
AT = r"(?:\s?@\s?|\s*[\[(]\s?(?:at|AT)\s?[\])]\s*)"
DOT = r"(?:\.|\s*[\[(]\s?(?:dot|DOT)\s?[\])]\s*)"
LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_+])?$")
DOMAIN = re.compile(rf"{AT}([A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}})(?![\w])")

PHONE = re.compile(
    r"(?<![\w+/-])(?:"
    r"\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){1,5}(?<=\d)"
    r"|(?:1[\s.-])?\(\d{3}\)[\s-]?\d{3}[\s.-]\d{4}"
    r"|(?:1[\s.-])?\d{3}([.-]|\s)\d{3}\1\d{4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r"|[2-9]\d{2}[.-]\d{4}"
    r")(?![\w-])"
)
ID = re.compile(
    r"(?<![\w+/-])(?:"
    r"\d{3}(-|\s)\d{2}\1\d{4}"
    r"|000\d{6}"
    r"|\d{9}"
    r"|[A-Z]\d{3}-\s?\d{4}-\s?\d{4}"
    r"|[A-Z]-\d{7,8}-[A-Z]"
    r"|\d{8}-[A-Z]"
    r"|[A-Z]{1,2}\d{6,8}[A-Z]?"
    r")(?![\w-])"
)
NOT_ID = re.compile(r"(?:tag|case|badge|unit|item|exhibit|invoice|order|file|ref|docket|no\.\s?of|plate|serial|report|evidence)s?(?:\s+(?:no\.?|number|nr\.?|#))?[\s:#]*$", re.I)
ID_CUE = re.compile(r"(?:licen[cs]e|\bid\b|identi|passport|passeport|pasaporte|document|ausweis|pass\b|ssn|social|dni|nie\b|cpf|card|number|nummer|num[eé]ro|n[uú]mero)", re.I)
KINDS = r"(?:Street|Avenue|Road|Lane|Drive|Court|Boulevard|Way|Place|Terrace|Circle|Square|Highway|Parkway|Trail|(?:St|Ave|Rd|Ln|Dr|Ct|Blvd|Pl|Ter|Cir|Sq|Hwy|Pkwy)\b\.?)"
ADDRESS_EN = re.compile(rf"(?<![\w#/.:-])\d{{1,5}}[A-Za-z]?\s+(?:(?:[NSEW]\.?|[A-Z][\w’'-]*)\s+){{1,4}}?{KINDS}(?![\w’'])(?:,?\s+(?:Unit|Apt\.?|Suite|Ste\.?|Flat|#)\s*#?\d+[A-Za-z]?\b)?")
ADDRESS_ES = re.compile(r"\b(?:[Cc]alle|[Cc]/|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Cc]arretera|[Rr]ua|[Tt]ravessa|[Pp]raça)\s+(?:(?:de|del|de\s+la|de\s+los|de\s+las|da|do|dos|das)\s+)?(?:[^\W\d_][\w’'-]*\s+){0,3}?[^\W\d_][\w’'-]*(?:,?\s+(?:n\.?º\s*)?)\d{1,5}[A-Za-z]?\b(?:,\s+\d{1,2}\.?º\s*[A-Z]?\b)?")
ADDRESS_FR = re.compile(r"(?<![\w#/.:-])\d{1,4}(?:\s?(?:bis|ter|[a-z]))?,?\s+(?:rue|avenue|boulevard|place|allée|impasse|chemin|quai|route|cours|passage|square)\s+(?:(?:de\s+la|de\s+l[’']|des|du|de|d[’'])\s*)?[^\W\d_][\w’'-]*(?:\s+[A-ZÀ-Þ][\w’'-]*)*")
ADDRESS_DE = re.compile(r"\b(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|steig|stieg|winkel|ring|damm|ufer|hof|berg|markt|graben|chaussee|pfad|wall|brücke|twiete)|(?:Am|An\s+der|Im|Auf\s+dem|Zum|Zur|Unter\s+den)\s+[A-ZÄÖÜ][\wäöüß-]+|[A-ZÄÖÜ][\wäöüß-]+\s+(?:Straße|Str\.|Weg|Platz|Allee|Ring|Gasse))\s+\d{1,4}\s?[a-z]?\b(?!\s*(?:Uhr|Grad|cm|m\b|kg))")
INITIALS_BEFORE = re.compile(rf"(?<![\w./])(?:[{UPPER}]\.\s){{1,2}}$")
SUFFIX = re.compile(r",?\s(?:Sr|Jr)\b\.?|\s(?:II|III|IV)\b")
#: What a wrongly decoded character looks like beside letters.
GARBLED = re.compile(r"Ã[^A-ZÀ-Þ\s]|[�√├┬Γ╨╤]|Â[\x80-\xbf]|â[\x80-\xbf€]|Ð[^\w\s]|Ñ[\x80-\xbf]|[À-ÿ][\x80-\x9f]")
WIDE = re.compile(r"[ァ-ヺ一-鿿]")
GERMAN = re.compile(r"\b(?:der|die|das|und|wohnt|nicht|ist)\b")
EASTERN = re.compile("[\u0144\u0103\u0151\u0155\u0119\u015f\u0154\u0102]")
SPACE = re.compile(r"\s")
NO_HOUSE = re.compile(r"\d{4}\s+(?:hrs|R/)")
PAGE_BEFORE = re.compile(r"(?:pp?|pages?|nos?)\.?\s*$", re.I)
AFTER = re.compile(r"\S*")
AFTER_ONE = re.compile(r"\S*(?:\s(?:[A-Z]\.\s)?[A-Z]\S*)?")
BEFORE_ONE = re.compile(r"([A-Z]\S*)\s(?:[A-Z]\.\s)?$")
NUMBERS = frozenset(("number",))
NUMBER = frozenset("0123456789 \t\n\r\u00a0().+-")
NUMBER_RUN = re.compile(r"[\d\s().+-]*")
STREET_BEFORE = re.compile(r"\d+[A-Za-z]?\s+(?:[A-Z][\w’']*\s+){1,4}$")
JA_NAME = re.compile(r"((?:[ァ-ヺー]{2,}|[一-鿿々]{1,5})(?:[ァ-ヺー一-鿿々]*)(?:[ 　\n](?:[ァ-ヺー一-鿿々]{1,6}))?)(?=さん|様|氏|君|ちゃん)")
ZH_NAME = re.compile(r"(?:(?:欧阳|司徒|司马|上官|诸葛|闻人|东方|夏侯|尉迟|皇甫|公孙|慕容|令狐|宇文|长孙|端木|南宫|独孤|轩辕|呼延|百里|澹台)[一-鿿]{1,2}|(?<![一-鿿])[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文][一-鿿]{1,2})(?=说|問|问|答|道|在|于|于是|告诉|认为|表示|来到|回到|离开|住|，|、|先生|女士|的证词|\n)")
UNCASED = re.compile(r"[؀-ۿऀ-ॿ฀-๿]")
AR_TITLE = re.compile(r"(?:د|السيد|السيدة|أ|الدكتور)\.?\s+([؀-ۿ]{2,}\s+[؀-ۿ]{2,})")
HI_TITLE = re.compile(r"(?:डॉ|श्री|श्रीमती|सुश्री)\.?\s+([ऀ-ॿ]{2,}\s+[ऀ-ॿ]{2,})")
TH_NAME = re.compile(r"(?:^|[\s“\"])([฀-๿]{3,12})\s([฀-๿]{8,})")


BROKEN = re.compile(BREAK)
OWNER = frozenset(("'s", "’s", "'S", "’S"))
LABEL = re.compile(rf"^\s*(?:>>\s*)?(?:<v\s+|[\[(]?\d{{1,2}}:\d{{2}}(?::\d{{2}})?[\])]?\s+)?((?:(?:{WORD})\.?[ ,]*){{1,5}})(?=\s*(?:[:>\t]|[–—-]\s|$))", re.M)


@lru_cache(maxsize=300_000)
def key_of(word: str) -> str:
    """A word as it is counted: without line breaks, possessive and case."""
    w = BROKEN.sub("", word) if "\n" in word else word
    if w[-2:] in OWNER:
        w = w[:-2]
    return w.lower().replace("’", "'")


@lru_cache(maxsize=300_000)
def class_of(raw: str) -> tuple[str, int]:
    """(key, class) of a token: 1 rank mark, 2 title, 3 title only with its stop, 4 initial, 5 capitals or digits, 0 other."""
    k = key_of(raw)
    if raw[:2] == "R/":
        return k, 1
    if k in TITLES and raw[-2:] not in OWNER:
        return k, 2 if len(k) > 2 else 3
    if len(k) == 1:
        return k, 4
    if raw.isupper() and len(raw) > 3 or not raw.isalpha() and any(c.isdigit() for c in raw):
        return k, 5
    return k, 0


def count_places(texts: Iterator[str]) -> Counter:
    """Counts of (kind, word, other): c - capitalised, m - so within a sentence, t - behind a title, p - pair of neighbours, f - full name, h - Thai."""
    c, m_, t, p_ = Counter(), Counter(), Counter(), Counter()
    n: Counter = Counter()
    memo: dict[str, tuple[str, int]] = {}
    for text in texts:
        pieces = SPLIT.split(text)  # gap, token, gap, token, ..., gap
        prev, titled, near = None, False, False
        for i in range(1, len(pieces), 2):
            raw = pieces[i]
            found = memo.get(raw)
            if found is None:
                if len(memo) > 300_000:
                    memo.clear()
                found = memo[raw] = class_of(raw)
            k, kind = found
            gap = pieces[i - 1]
            near = near and (gap == " " or gap == "\n" or gap.isspace() and len(gap) == 2)
            if kind == 0:
                c[k] += 1
                if len(gap) > 1 and gap[-1] in " \n" and (gap[-2].islower() or gap[-2] == ","):
                    m_[k] += 1
                if near:
                    if titled:
                        t[k] += 1
                    if prev is not None:
                        p_[prev, k] += 1
                prev, titled, near = k, False, True
                continue
            after = pieces[i + 1]
            if kind == 1:
                prev, titled, near = None, True, True
            elif kind == 4 or k == "m" and prev is not None and near:
                if (prev is not None or titled) and near and after[:1] == ".":
                    pieces[i + 1] = after[1:]  # an initial between
                else:
                    prev, titled, near = None, False, False
            elif kind in (2, 3):
                stop = after[:1] == "."
                if kind == 3 and not stop or k == "dr" and STREET_BEFORE.search("".join(pieces[max(0, i - 8) : i])):
                    prev, titled, near = None, False, False
                else:
                    prev, titled, near = None, True, True
                    if stop:
                        pieces[i + 1] = after[1:]
            else:
                prev, titled, near = None, False, False
        if UNCASED.search(text):
            for p in (AR_TITLE, HI_TITLE):
                for m in p.finditer(text):
                    n["f", " ".join(m.group(1).split()), ""] += 1
            for m in TH_NAME.finditer(text):
                n["h", m.group(1), m.group(2)] += 1
    for name, part in (("c", c), ("m", m_), ("t", t)):
        for k, v in part.items():
            n[name, k, ""] = v
    for (a, b), v in p_.items():
        n["p", a, b] = v
    return n


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter = Counter()
    for pdf in batches:
        n += count_places(pdf["text"])
        if len(n) > 500_000:
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "word", "other", "n"])
            n = Counter()
    yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "word", "other", "n"])


def lexicon(texts: DataFrame) -> DataFrame:
    """(word) name words (folded) and full names of uncased scripts, of a DataFrame with a column ``text``."""
    raw = texts.select("text").mapInPandas(_count, "kind string, word string, other string, n bigint")
    counts = cut(raw.groupBy("kind", "word", "other").agg(F.sum("n").alias("n")))  # read several times below
    never = F.col("word").isin(*sorted(NEVER | TITLES))
    total = counts.where("kind = 'c'").select("word", F.col("n").alias("total"))
    titled = counts.where("kind = 't'").select("word", F.col("n").alias("hits"))
    seeds = titled.join(total, "word").where(~never & (F.col("hits") >= MIN_SHARE * F.col("total"))).select("word")
    within = counts.where("kind = 'm'").select("word", F.col("n").alias("inside")).join(total, "word").where("inside >= 0.05 * total").select("word")
    pairs = counts.where("kind = 'p'").select("word", "other", "n")

    def grow(known: DataFrame, share: float) -> DataFrame:
        k = known.select("word").distinct()
        left = pairs.join(k.withColumnRenamed("word", "other"), "other").groupBy("word").agg(F.sum("n").alias("hits"))
        left = left.join(within, "word").select("word", "hits")  # what only opens sentences is no first name
        right = pairs.join(k, "word").groupBy(F.col("other").alias("word")).agg(F.sum("n").alias("hits"))
        new = left.unionByName(right).groupBy("word").agg(F.max("hits").alias("hits")).join(total, "word")
        return k.union(new.where(~never & (F.col("hits") >= share * F.col("total")) & (F.col("hits") >= 2)).select("word")).distinct()

    words = grow(grow(seeds, MIN_SHARE), 0.25)
    full = counts.where("kind = 'f' and n >= 2").select("word")
    # Thai runs words together: a given name before several continuations shares the surname with all of them
    thai = counts.where("kind = 'h'").groupBy("word").agg(F.min("other").alias("a"), F.max("other").alias("b"), F.count("*").alias("k")).where("k >= 2")
    thai = thai.select("word", "a", "b").withColumn("m", F.expr("size(filter(sequence(1, least(length(a), length(b))), i -> left(a, i) = left(b, i)))")).where("m >= 3").select(F.concat_ws(" ", "word", F.expr("left(a, m)")).alias("word"))
    return words.union(full).union(thai).where(F.length("word") >= 2)


STREET_CUES = {
    "en": "Street St Avenue Ave Road Rd Lane Ln Drive Dr Court Ct Boulevard Blvd Way Place Pl Terrace Circle Square Highway Parkway Trail".split(),
    "es": "calle Calle C/ c/ avenida Avenida avda Avda plaza Plaza paseo Paseo camino Camino ronda Ronda carretera Carretera rua Rua travessa Travessa praça Praça".split(),
    "fr": "rue avenue boulevard place allée impasse chemin quai route cours passage square".split(),
    "de": "straße strasse str. gasse weg platz allee steig stieg winkel ring damm ufer hof berg markt graben chaussee pfad wall brücke twiete Straße Str. Weg Platz Allee Ring Gasse".split(),
}


ID_CUES = "license licence id identi passport passeport pasaporte document ausweis pass ssn social dni nie cpf card number nummer numero numéro número".split()


def anchors():
    """The automaton over all anchors; a hit gives (length, kinds of parser to start there)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    cues: dict[str, set[str]] = {}
    for lang, words in STREET_CUES.items():
        for w in words:
            for tail in " \n" if lang in ("de", "fr", "es") else " \n.,":
                for head in ("",) if lang == "de" else (" ", "\n"):
                    cues.setdefault(head + w + tail, set()).add(lang)
    for w in ("Am ", "An der ", "Im ", "Auf dem ", "Zum ", "Zur ", "Unter den "):
        cues.setdefault(w, set()).add("de lead")
    cues["@"] = {"email"}
    for opener in "[(":
        for gap in ("", " ", "\n"):
            for at in ("at", "AT", "At"):
                cues.setdefault(opener + gap + at, set()).add("email")
    for w in ID_CUES:
        for form in (w, w.capitalize(), w.upper()):
            cues.setdefault(form, set()).add("cue")
    for n in range(1000):  # groups of three digits
        cues.setdefault(f"{n:03d}", set()).add("number")
    for n in range(10):  # dialling signs
        cues.setdefault(f"+{n}", set()).add("number")
    for w, kinds in cues.items():
        a.add_word(w, (len(w), NUMBERS if kinds == {"number"} else frozenset(kinds)))
    a.make_automaton()
    return a


def listed(text: str, start: int, end: int) -> bool:
    """Whether a name that reaches a line end fills its line but for titles, as in a list of persons: the next line is another."""
    begin = text.rfind("\n", 0, start) + 1
    words = text[begin:start].split()
    return " " in text[start:end] and len(words) < 4 and all(w.strip(".,-*•").lower() in TITLES or not w.strip(".-*•)") or w.rstrip(".)").isdigit() for w in words)


def words_back(text: str, at: int, n: int) -> int:
    """Where the ``n`` words before a place begin."""
    width = 120
    while True:
        lo = max(0, at - width)
        parts = text[lo:at].rsplit(None, n)
        if len(parts) > n or lo == 0:
            return lo + len(parts[0]) if len(parts) > n else 0
        width *= 2


def words_on(text: str, at: int, n: int) -> int:
    """Where the ``n`` words from a place on end, at the end of a word."""
    width = 160
    while True:
        hi = min(len(text), at + width)
        parts = text[at:hi].split(None, n)
        if len(parts) > n or hi == len(text):
            return hi - len(parts[n]) if len(parts) > n else len(text)
        width *= 2


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Finder:
    """Finds spans (kind, start, end) in a text.  ``known``: the name lexicon."""

    def __init__(self, known: set[str]):
        self.known = known
        self.memo: dict[str, tuple[str, int, bool]] = {}
        self.anchors = anchors()
        full = sorted((w for w in known if UNCASED.search(w)), key=len, reverse=True)
        self.full = re.compile("|".join(r"\s".join(map(re.escape, w.split(" "))) for w in full)) if full else None

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        at: dict[str, list[int]] = {}
        run = -9
        for end, (n, kinds) in self.anchors.iter(text):
            if kinds is NUMBERS:  # the first group of a run stands for it
                if end != run + 1:
                    at.setdefault("number", []).append(end + 1 - n)
                run = end
                continue
            for k in kinds:
                if k != "de" or text[end + 1 : end + 2].isdigit():
                    at.setdefault(k, []).append(end + 1 - n)
        spans: list[tuple[str, int, int]] = []
        taken = bytearray(len(text) + 1)

        def add(kind: str, s: int, e: int) -> None:
            """Takes a span where nothing is taken yet."""
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\x01" * (e - s)
                spans.append((kind, s, e))

        if "email" in at:
            self.emails(text, at["email"], add)
        self.addresses(text, at, add)
        if "number" in at:
            self.numbers(text, sorted(at["number"]), sorted(at.get("cue", ())), add)
        spans += self.names(text, taken)
        return sorted(spans, key=lambda x: (x[1], x[2]))

    @staticmethod
    def emails(text: str, places: list[int], add: Callable[[str, int, int], None]) -> None:
        """Expands at-signs to the local part before and the domain behind them."""
        for at in sorted(places):
            a = EMAIL_ANCHOR.match(text, at)
            if a is None:
                continue
            left = text[max(0, at - 100) : at]
            if a.group() != "@":
                left = left.rstrip()
            lm = LOCAL.search(left)
            if lm is None:
                continue
            begin = max(0, at - 100)
            dm = DOMAIN.match(text, begin + len(left))
            if dm is not None:
                add("email", begin + lm.start(), dm.end())

    @staticmethod
    def addresses(text: str, at: dict[str, list[int]], add: Callable[[str, int, int], None]) -> None:
        """Expands street kinds to house number, street and unit, in windows of whole words."""
        german = at.get("de", [])
        if "de lead" in at and GERMAN.search(text):
            german = german + at["de lead"]
        for lang, places, pattern in (("en", at.get("en", ()), ADDRESS_EN), ("es", at.get("es", ()), ADDRESS_ES), ("fr", at.get("fr", ()), ADDRESS_FR), ("de", german, ADDRESS_DE)):
            for lo, hi in merged([(words_back(text, p + 1, 7), words_on(text, p + 1, 12)) for p in places]):
                for m in pattern.finditer(text, lo, hi):
                    if lang != "en" or not NO_HOUSE.match(m.group()):
                        add("address", *m.span())

    @staticmethod
    def numbers(text: str, places: list[int], cues: list[int], add: Callable[[str, int, int], None]) -> None:
        """Expands groups of digits to the run of digits and separators around them and parses those."""
        windows: list[tuple[int, int]] = []
        done = 0
        for p in places:
            if p < done:
                continue
            lo = p
            while lo > done and text[lo - 1] in NUMBER:
                lo -= 1
            done = NUMBER_RUN.match(text, p).end()
            windows.append((max(0, lo - 4), done + 4))
        windows = merged(windows)
        for m in (x for lo, hi in windows for x in ID.finditer(text, lo, hi)):
            s, e = m.span()
            before = text[max(0, s - 45) : s]
            if NOT_ID.search(before):
                continue
            d = m.group()
            if d.isdigit() and not d.startswith("000"):
                k = bisect_left(cues, s - 45)
                if not any(ID_CUE.match(text, c) for c in cues[k : bisect_left(cues, s)]):
                    continue
            add("idnum", s, e)
        for m in (x for lo, hi in windows for x in PHONE.finditer(text, lo, hi)):
            s, e = m.span()
            n = sum(c.isdigit() for c in m.group())
            if NOT_ID.search(text[max(0, s - 30) : s]) or not 7 <= n <= 15:
                continue
            if n == 7 and PAGE_BEFORE.search(text[max(0, s - 8) : s]):
                continue
            add("phone", s, e)

    def names(self, text: str, taken: bytearray) -> list[tuple[str, int, int]]:
        known, memo = self.known, self.memo
        out: list[list] = []
        prev_end, titled, open_name = -9, False, False
        pieces = SPLIT.split(text)
        e = 0
        for i in range(1, len(pieces), 2):
            raw = pieces[i]
            s = e + len(pieces[i - 1])
            e = s + len(raw)
            found = memo.get(raw)
            if found is None:
                if len(memo) > 300_000:
                    memo.clear()
                k, kind = class_of(raw)
                found = memo[raw] = (k, kind, kind in (0, 5) and (k in known or ("-" in k or "'" in k) and self.compound(k)))
            k, kind, hit = found
            if not hit and not titled and not open_name and (kind == 0 or kind == 5):
                continue
            if taken[s]:
                prev_end, titled, open_name = -9, False, False
                continue
            if kind == 1:
                prev_end, titled, open_name = e, True, False
                continue
            between = text[prev_end:s] if 0 < s - prev_end <= 2 else ""
            close = between.isspace() and between.count("\n") < 2 and "\t" not in between
            stop = text[e : e + 1] == "."
            if kind == 4 or k == "m" and open_name and close:
                if stop and close and (open_name or titled):
                    prev_end = e + 1
                elif not stop:
                    prev_end, titled, open_name = -9, False, False
                continue
            if kind in (2, 3):
                if k in ("sr", "fr", "me", "m") and not stop or kind == 3 and not stop:
                    prev_end, titled, open_name = -9, False, False
                elif k == "sr" and open_name and close:
                    pass  # a suffix
                elif k == "dr" and STREET_BEFORE.search(text[max(0, s - 60) : s]):
                    prev_end, titled, open_name = -9, False, False
                else:
                    prev_end, titled, open_name = e + stop, True, False
                continue
            if not hit and close and k not in NEVER:
                digits = sum(c.isdigit() for c in k)
                hit = titled and not raw.isupper() and len(k) > 2 and digits < 2 or open_name and len(k) > 4 and (digits > 0 or "ſ" in raw)
            if hit and k not in NEVER:
                end = e - 2 if raw[-2:] in OWNER else e
                if open_name and close and not ("\n" in between and listed(text, out[-1][1], prev_end)):
                    out[-1][2] = end
                else:
                    out.append(["name", s, end])
                open_name, prev_end, titled = end == e, e, False
            else:
                prev_end, titled, open_name = -9, False, False
        for span in out:
            # an initial leads a surname; before a full name it is a title (M.) or a label (A.)
            if text[max(0, span[1] - 2) : span[1] - 1] == "." and SPACE.search(text, span[1], span[2]) is None and (im := INITIALS_BEFORE.search(text, max(0, span[1] - 8), span[1])) is not None:
                span[1] = im.start()
            if (sm := SUFFIX.match(text, span[2])) is not None:
                span[2] = sm.end()
        found = [tuple(x) for x in out]
        if not text.isascii():
            wide = WIDE.search(text) is not None
            if GARBLED.search(text) or EASTERN.search(text):
                found = [x for x in found if not self.garbled(text, x[1], x[2])]
            for p in (JA_NAME, ZH_NAME) if wide else ():
                found += [("name", *m.span()) for m in p.finditer(text)]
            if self.full is not None and UNCASED.search(text):
                found += [("name", *m.span()) for m in self.full.finditer(text)]
        return found


    def compound(self, k: str) -> bool:
        """A hyphen may join two names or stand for a broken word: the parts or the whole may be known."""
        return k.replace("-", "") in self.known or all(p in self.known for p in re.split(r"[-']", k) if len(p) > 1)

    def garbled(self, text: str, s: int, e: int) -> bool:
        """Whether a name holds, or goes on in, wrongly decoded characters."""
        one = " " not in text[s:e] and "\n" not in text[s:e]
        tail = (AFTER_ONE if one else AFTER).match(text, e).group()
        if GARBLED.search(text[s:e] + tail):
            return True
        if any(c in "\u0144\u0103\u0151\u0155\u0119\u015f\u0154\u0102" for c in text[s:e]):
            # letters of another code page: garbled when the same bytes give a known name in the western one
            for w in TOKEN.findall(text[s:e]):
                other = w.encode("cp1250", "ignore").decode("cp1252", "ignore")
                if len(other) == len(w) and other != w and key_of(other) in self.known:
                    return True
        m = BEFORE_ONE.search(text[max(0, s - 40) : s]) if one else None
        return m is not None and GARBLED.search(m.group(1)) is not None


def own_words(text: str, listed: str | None, known: set[str]) -> set[str]:
    """Name words that a record itself gives: its listed person and, for a transcript, its roster and speaker labels."""
    from inkgraph.llm import turns
    from inkgraph.llm.canon import edit

    words: set[str] = set()
    if listed:
        words |= {key_of(w) for w in TOKEN.findall(listed) if len(key_of(w)) > 2}
    if (m := turns.PARTICIPANTS.search(text)) is not None:
        roster, _, body = turns.roster_of(text)
        listed_words = {key_of(w) for line in roster for w in TOKEN.findall(line) if len(key_of(w)) > 2} - TITLES - NEVER
        words |= listed_words
        for label in {m.group(1) for m in LABEL.finditer(body)}:
            for w in TOKEN.findall(label):
                k = key_of(w)
                if len(k) > 3 and k not in known and k not in words and k not in TITLES and k not in NEVER and any(edit(k, x, 2) <= 2 for x in listed_words if len(x) > 4):
                    words.add(k)
    return words - TITLES - NEVER


def find(texts: DataFrame) -> DataFrame:
    """(src, row_id, kind, start_char, end_char) of the spans in rows (src, row_id, text, listed)."""
    texts = texts.where(F.length(F.trim("text")) > 0)
    words = cut(lexicon(texts))
    size = words.limit(MAX_LEXICON + 1).count()
    schema = "src string, row_id bigint, kind string, start_char int, end_char int"

    def rows(pdf: pd.DataFrame, finder_of, known=frozenset()) -> pd.DataFrame:
        out = []
        for i, (src, key, text, listed) in enumerate(zip(pdf["src"], pdf["row_id"], pdf["text"], pdf["listed"], strict=True)):
            finder = finder_of(i, own_words(text, listed, known))
            out += [(src, key, kind, s, e) for kind, s, e in finder(text)]
        return pd.DataFrame(out, columns=["src", "row_id", "kind", "start_char", "end_char"])

    if size <= MAX_LEXICON:
        shared = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in words.collect()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base = Finder(set(shared.value))

            def finder_of(i: int, own: set[str]) -> Finder:
                more = own - base.known
                if not more:
                    return base
                one = Finder.__new__(Finder)
                one.memo = {}
                one.known, one.full, one.anchors = _Union(base.known, more), base.full, base.anchors
                return one

            for pdf in batches:
                yield rows(pdf, finder_of, base.known)

        return texts.mapInPandas(run, schema)

    # a lexicon too large to broadcast: each text gets by a join the known ones among all that a finder may ask for
    @F.pandas_udf("array<string>")
    def candidates(text: pd.Series) -> pd.Series:
        return text.map(asked)

    each = texts.select("src", "row_id", F.explode(candidates("text")).alias("key")).distinct()
    # names of uncased scripts stand anywhere in a text and meet it by their beginnings
    held = words.distinct().withColumn("key", F.when(F.col("word").rlike(UNCASED.pattern), F.concat(F.lit("\t"), F.substring("word", 1, 4))).otherwise(F.col("word")))
    mine = each.join(held, "key").groupBy("src", "row_id").agg(F.collect_set("word").alias("mine"))

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in range(len(pdf)):
                have = set() if pdf["mine"].iloc[i] is None else set(pdf["mine"].iloc[i])
                base = Finder(have)

                def finder_of(_: int, own: set[str], base=base) -> Finder:
                    base.known = _Union(base.known, own)  # as in the shared path, own words are no part of ``full``
                    return base

                out.append(rows(pdf.iloc[i : i + 1], finder_of, have))
            if out:
                yield pd.concat(out, ignore_index=True)

    return texts.join(mine, ["src", "row_id"], "left").select("src", "row_id", "text", "listed", "mine").mapInPandas(run_own, schema)


def asked(text: str) -> list[str]:
    """Every word that a finder may look up in the lexicon for a text; beginnings of names of uncased scripts after a tab."""
    out = set()
    for raw in TOKEN.findall(text):
        k = key_of(raw)
        out |= {k, k.replace("-", ""), *re.split(r"[-']", k)}
        if not raw.isascii():
            out.add(key_of(raw.encode("cp1250", "ignore").decode("cp1252", "ignore")))
    if UNCASED.search(text):
        flat = re.sub(r"\s", " ", text)
        out |= {"\t" + flat[i : i + n] for i in range(len(flat)) for n in (1, 2, 3, 4)}
    return sorted(out - {""})


class _Union:
    """Two sets read as one."""

    def __init__(self, a: set[str], b: set[str]):
        self.a, self.b = a, b

    def __contains__(self, x: str) -> bool:
        return x in self.b or x in self.a


def gather(documents: DataFrame, interviews: DataFrame, biographies: DataFrame) -> DataFrame:
    """The three tables as rows (src, row_id, text, listed)."""
    none = F.lit(None).cast("string")
    a = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "text", none.alias("listed"))
    b = interviews.select(F.lit("suspect_interviews").alias("src"), F.col("id").alias("row_id"), F.col("interview_text").alias("text"), F.col("suspect_name").alias("listed"))
    c = biographies.select(F.lit("victim_biographies").alias("src"), F.col("id").alias("row_id"), F.col("biography").alias("text"), F.col("victim_name").alias("listed"))
    return a.unionByName(b).unionByName(c)


def redact(texts: DataFrame) -> DataFrame:
    """(src, row_id, redacted_text): the texts with each span replaced by its typed placeholder, the rest unchanged."""
    spans = find(texts).groupBy("src", "row_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "kind"))).alias("spans"))

    @F.pandas_udf("string")
    def fill(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans, strict=True):
            parts, at = [], 0
            for s in [] if ss is None else ss:
                if s["start_char"] >= at:
                    parts += [t[at : s["start_char"]], f"[{s['kind'].upper()}]"]
                    at = s["end_char"]
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out)

    return texts.join(spans, ["src", "row_id"], "left").select("src", "row_id", fill("text", "spans").alias("redacted_text"))
