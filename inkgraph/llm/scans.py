"""Problem 7: noise in text from scanned pages.

Method.  The corpus gives a frequency lexicon of its words.  Every rare word meets the frequent words within reach
through a symmetric-delete index (both sides leave out one letter, or two neighbouring ones, and are joined on what is
left); candidates are judged by a weighted edit distance in which confusions of shapes (1/l, 0/o, rn/m, vv/w, c/e, long s,
ligatures ...) cost little, and by how much more often the corpus says the candidate; where several remain, the words
before decide (bigram context).  Words cut at a line end are rejoined unless the corpus knows the compound with its
hyphen.  Running headers are short title-like lines that come back on two or more pages, page numbers are lines of their
own; bare numbers below each other or below a line that announces them are a list.  Both go, and the lines are joined
into paragraphs.

Scale.  Words are counted per Arrow batch before the shuffle.  The delete index is joined on distinct words only.  The
texts are then passed once more; only words that are not among the ``COMMON`` most frequent clean words leave that pass
(a filter of fixed size that spares traffic and drops nothing: frequent words that are damaged are taken out of it) and
are joined with the damaged words.  No text is shuffled for the finding, nothing is collected that grows with the data.

Edge cases: null and blank texts have no damage; hard line ends and the text's own heading are none; a header on one page
only is none; a hyphen of a compound that the corpus writes with it is none; words of scripts without case take part in
the lexicon as they stand; repeated rows are judged alike; very long texts are read whole.  By definition a word that may be
misread has 2 to ``LONGEST`` characters (of two, one must be a digit or sign), a running header 4 to 70.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.canon import edit
from inkgraph.session import cut

COMMON = 50_000
#: Characters of the longest word that is judged as one; what runs on longer is a line of a script without spaces or an address.
LONGEST = 32
EDGE = " \t.,;:?\"'()[]{}<>“”„‘’«»‹›…–—-*#/\\¿¡。，、？！：；（）「」"
ODD = re.compile(r"[0-9@!|ſﬁﬂ]")
HYPHEN = re.compile(r"[-‐¬­]\n[^\S\n]*")
LEFT = re.compile(r"[^\W\d_][\w’'@!|$]*$")
RIGHT = re.compile(r"[^\W\d_][\w’'@!|$]*")
#: Lines of a page number: bare, or behind the word for a page in the languages of the corpus, with the number of pages.
PAGENO = re.compile(r"[-–—\[(|·•~\s]*(?:(?:p(?:a[gq][ec]|[gq]|[áa]g(?:ina)?|\.)?|seite|стр(?:аница)?|صفحة|पृष्ठ|หน้า|第)[.\s]*)?[0-9OolI]{1,3}(?:\s*(?:of|/|[0o]f|von|de|из)\s*[0-9OolI]{1,3})?\s*(?:页|頁|ページ)?[-–—\])|·•~\s]*", re.I)
BARE = re.compile(r"\d{1,3}")
TERMINAL = tuple(".!?…”»。！？।؟,;:—–-")

#: Shapes that a reader confuses: misread -> read (lower case).
CONFUSIONS: dict[str, tuple[str, ...]] = {
    "1": ("l", "i"), "0": ("o",), "5": ("s",), "8": ("b",), "6": ("b",), "9": ("g",), "@": ("a",), "!": ("i", "l"), "|": ("l", "i"), "ſ": ("s", "f"), "ﬁ": ("fi",), "ﬂ": ("fl",),
    "c": ("e",), "e": ("c",), "f": ("t",), "b": ("h",), "h": ("b",), "q": ("g",), "l": ("i",), "i": ("l",), "ii": ("u",), "rn": ("m",), "m": ("rn",), "vv": ("w",), "cl": ("d",), "d": ("cl",), "nn": ("m",), "li": ("h",), "tl": ("d",),
}


WIDE = re.compile(r"[぀-ヿ一-鿿]")  # scripts without case whose sentences have end marks
HEAD_WORD = re.compile(r"[^\W_][\w’'ſ!@|$]*")


def clean_token(w: str) -> str:
    w = w.strip(EDGE)
    if w[-1:] in "!|" and len(w) > 1:
        w = w.rstrip("!|").strip(EDGE)
    for tail in ("'s", "’s"):
        if w.endswith(tail):
            w = w[:-2]
    return w


def words_of(text: str) -> list[str]:
    """Words of a text (folded) that may be misread or be what others are misread from."""
    out = []
    for raw in text.split():
        if len(raw) < 2 or raw.isdigit():
            continue
        w = clean_token(raw)
        if 2 <= len(w) <= LONGEST and any(c.isalpha() for c in w):
            out.append(w.lower())
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter = Counter()
    memo: dict[str, str | None] = {}
    for pdf in batches:
        raw: Counter = Counter()
        for t in pdf["text"]:
            raw.update(t.split())
        for x, k in raw.items():
            if x not in memo:
                if len(memo) > 500_000:
                    memo.clear()
                got = words_of(x)
                memo[x] = got[0] if got else None
            if (w := memo[x]) is not None:
                n[w] += k
        if len(n) > 500_000:
            yield pd.DataFrame(list(n.items()), columns=["word", "n"])
            n = Counter()
    yield pd.DataFrame(list(n.items()), columns=["word", "n"])


def deletes(w: str) -> list[str]:
    """A word with one letter, or two neighbouring ones, left out, and the word itself; of two letters, one as a blank."""
    if len(w) == 2:
        return [w, w[0] + "_", "_" + w[1]]
    out = {w}
    for i in range(len(w)):
        out.add(w[:i] + w[i + 1 :])
        if i + 2 <= len(w):
            out.add(w[:i] + w[i + 2 :])
    return [x for x in out if len(x) >= 2]


@lru_cache(maxsize=100_000)
def misread_cost(word: str, true: str) -> float:
    """Weighted edit distance from a written word to what it may have been; 9 when more than confusions are needed."""
    inf = 9.0
    a, b = word, true
    best = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    best[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            now = best[i][j]
            if now >= 2:
                continue
            if i < len(a) and j < len(b) and a[i] == b[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], now)
            for n in (1, 2, 3):
                for to in CONFUSIONS.get(a[i : i + n], ()) if i + n <= len(a) else ():
                    if b.startswith(to, j):
                        best[i + n][j + len(to)] = min(best[i + n][j + len(to)], now + 0.5)
    return best[len(a)][len(b)]


def is_candidate_pair(word: str, n: int, true: str, m: int) -> bool:
    """Whether the corpus says that ``word`` is a misreading of ``true``: enough more often, and only confusions apart."""
    if word == true or ODD.search(true):
        return False
    cost = misread_cost(word, true)
    if cost > 1.0:
        return False
    odd = ODD.search(word) is not None
    if odd:
        return m >= (n if len(word) > 2 else 20 * n)  # short codes are as likely as short words
    if len(word) < 4 and len(true) < 4:
        return False
    return m >= max(3, (8 if cost <= 0.5 else 20) * n)


def damaged_words(counts: DataFrame) -> DataFrame:
    """(word, true, m): misread words and what they may have been.  ``counts``: (word, n)."""

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(deletes)

    @F.pandas_udf("boolean")
    def fits(word: pd.Series, n: pd.Series, true: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([is_candidate_pair(*x) for x in zip(word, n, true, m, strict=True)])

    # words that hold a misread shape at all, against words that are said more often
    left = counts.select("word", "n", F.explode(keys("word")).alias("key"))
    right = counts.where((F.col("n") >= 2) & ~F.col("word").rlike(ODD.pattern)).select(F.col("word").alias("true"), F.col("n").alias("m"), F.explode(keys("word")).alias("key"))
    pairs = left.join(right, "key").where((F.col("word") != F.col("true")) & (F.col("m") >= F.col("n"))).select("word", "n", "true", "m").distinct()
    found = pairs.where(fits("word", "n", "true", "m")).select("word", "true", "m")

    @F.pandas_udf("string")
    def shape(words: pd.Series) -> pd.Series:
        return pd.Series([odd_form(w) for w in words], dtype=object)

    # digits and signs within a word are a misreading even where the corpus lacks the true word
    alone = counts.where(F.col("word").rlike(ODD.pattern)).withColumn("true", shape("word")).where(F.col("true").isNotNull()).select("word", "true", F.lit(0).cast("bigint").alias("m"))
    return found.unionByName(alone)


SIGNED = re.compile(r"[a-zà-öø-ÿœ][a-zà-öø-ÿœ'’-]*(?:[01568!@|ſﬁﬂ]{1,2}[a-zà-öø-ÿœ'’-]+){1,2}|[!|ſﬁﬂ@][a-zà-öø-ÿœ'’-]{3,}")


def odd_form(word: str) -> str | None:
    """The plain reading of a word of letters with one or two signs or digits among them; None for codes and numbers."""
    if SIGNED.fullmatch(word) is None or sum(c.isalpha() and c.isascii() for c in word) < 3:
        return None
    return "".join(CONFUSIONS[c][0] if ODD.match(c) else c for c in word)


def page_lines(lines: list[str]) -> tuple[set[int], set[int]]:
    """(lines with a page number, lines of running headers) by index."""
    bare = [x.strip() for x in lines]
    numbers = {i for i, x in enumerate(bare) if x and len(x) <= 24 and PAGENO.fullmatch(x) and any(c.isdigit() for c in x)}
    # bare numbers below each other, or below a line that announces them, are a list
    told = [i for i, x in enumerate(bare) if x]
    listed = {k for a, b in zip(told, told[1:], strict=False) for k in (a, b) if BARE.fullmatch(bare[b]) and (BARE.fullmatch(bare[a]) or bare[a].endswith((":", "："))) and BARE.fullmatch(bare[k])}
    numbers -= listed
    short = [(i, x) for i, x in enumerate(bare) if 4 <= len(x) <= 70 and x[0] not in "#“«\"•*[" and not x[0].islower() and not x.endswith(TERMINAL) and i not in numbers]
    heads, tails = Counter(x[:5] for _, x in short), Counter(x[-5:] for _, x in short)
    groups: dict[str, list[int]] = {}
    for i, x in short:
        if heads[x[:5]] < 2 and tails[x[-5:]] < 2:
            continue
        words = [w for w in HEAD_WORD.findall(x) if sum(c.isalpha() for c in w) > 2]
        if not words or "[" in x:
            continue
        lower = sum(w[0].islower() for w in words)
        cased = any(w[0].isupper() for w in words) or not any(w[0].lower() != w[0].upper() for w in words) and WIDE.search(x) is not None
        if lower > 0.2 * len(words) or not cased:
            continue
        groups.setdefault(re.sub(r"\W+", " ", x).strip().casefold(), []).append(i)
    # one header, read a little differently on each page: keys that begin or end alike are compared
    ends: dict[str, list[str]] = {}
    for k in groups:
        ends.setdefault("^" + k[:5], []).append(k)
        ends.setdefault("$" + k[-5:], []).append(k)
    merged: list[list[int]] = []
    used: set[str] = set()
    for k in groups:
        if k in used:
            continue
        rows = list(groups[k])
        for o in dict.fromkeys(ends["^" + k[:5]] + ends["$" + k[-5:]]):
            if o != k and o not in used and abs(len(o) - len(k)) <= 2 and len(k) > 8 and edit(k, o, 2) <= 2:
                rows += groups[o]
                used.add(o)
        used.add(k)
        merged.append(sorted(rows))
    headers: set[int] = set()
    for rows in merged:
        if len(rows) >= 2 and rows[-1] - rows[0] >= 2:
            headers |= set(rows)
    return numbers, headers


def last_word(text: str, end: int) -> str:
    """The word that ends at a place."""
    at = end
    while at and not text[at - 1].isspace():
        at -= 1
    return text[at:end]


def marks(text: str, common: frozenset[str] | set[str], memo: dict[str, str | None]) -> list[tuple[str, str | None, str | None]]:
    """(kind, word, other) of what may be damage in a text: header and pageno are certain, hyphen and char wait for the lexicon."""
    out: list[tuple[str, str | None, str | None]] = []
    if "\n" in text:
        numbers, headers = page_lines(text.split("\n"))
        if numbers:
            out.append(("pageno", None, None))
        if headers:
            out.append(("header", None, None))
        seen = set()
        for m in HYPHEN.finditer(text):
            lm, rm = LEFT.search(last_word(text, m.start())), RIGHT.match(text, m.end())
            if lm is None or rm is None:
                continue
            a, b = lm.group(), rm.group()
            pair = ((a + b).lower(), f"{a}-{b}".lower())
            if pair not in seen:
                seen.add(pair)
                out.append(("hyphen", *pair))
    words = set()
    for raw in set(text.split()):
        if raw not in memo:
            if len(memo) > 300_000:
                memo.clear()
            got = words_of(raw)
            memo[raw] = got[0] if got and got[0] not in common else None
        words.add(memo[raw])
    out += [("char", w, None) for w in words if w is not None]
    return out


def gather(documents: DataFrame, narratives: DataFrame) -> DataFrame:
    a = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "text", F.lit(None).cast("string").alias("intake"))
    b = narratives.select(F.lit("narratives").alias("src"), F.col("id").alias("row_id"), "text", "intake")
    return a.unionByName(b).where(F.length(F.trim("text")) > 0)


def counted(texts: DataFrame) -> DataFrame:
    raw = texts.select("text").mapInPandas(_count, "word string, n bigint")
    return raw.groupBy("word").agg(F.sum("n").alias("n"))


def find(texts: DataFrame) -> DataFrame:
    """(src, row_id, kind) of the damage in rows (src, row_id, text)."""
    counts = cut(counted(texts))
    damaged = cut(damaged_words(counts).groupBy("word").agg(F.max_by("true", F.struct("m", "true")).alias("true")))
    top = counts.join(damaged, "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON)
    common = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in top.select("word").collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = common.value
        memo: dict[str, str | None] = {}
        for pdf in batches:
            rows = [(s, r, *x) for s, r, t in zip(pdf["src"], pdf["row_id"], pdf["text"], strict=True) for x in marks(t, known, memo)]
            yield pd.DataFrame(rows, columns=["src", "row_id", "kind", "word", "other"])

    found = cut(texts.select("src", "row_id", "text").mapInPandas(run, "src string, row_id bigint, kind string, word string, other string"))
    sure = found.where("kind in ('header', 'pageno')").select("src", "row_id", "kind")
    char = found.where("kind = 'char'").join(damaged.select("word"), "word", "left_semi").select("src", "row_id", "kind")
    joined, compound = counts.select("word", F.col("n").alias("n_joined")), counts.select(F.col("word").alias("other"), F.col("n").alias("n_compound"))
    hyphen = found.where("kind = 'hyphen'").join(joined, "word", "left").join(compound, "other", "left")
    hyphen = hyphen.where(F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))).select("src", "row_id", "kind")
    return sure.union(char).union(hyphen).distinct()


def rebuild(text: str, words: dict[str, str], compounds: frozenset[str] | set[str]) -> str:
    """A text as continuous paragraphs: headers and page numbers out, cut words joined, misread words replaced."""
    lines = text.split("\n")
    numbers, headers = page_lines(lines)
    kept = [x for i, x in enumerate(lines) if i not in numbers and i not in headers]
    out: list[str] = []
    para = ""
    for line in (x.strip() for x in kept):
        if not line:
            if para:
                out.append(para)
            para = ""
            continue
        cut_at = re.search(r"[-‐¬­]$", para)
        lm = LEFT.search(last_word(para, len(para) - 1)) if cut_at else None
        rm = RIGHT.match(line)
        if lm is not None and rm is not None:
            whole = f"{lm.group()}-{rm.group()}".lower() in compounds
            para = (para[:-1] + "-" if whole else para[:-1]) + line
        else:
            para = f"{para} {line}" if para else line
    if para:
        out.append(para)
    text = "\n\n".join(out)
    if not words:
        return text

    def mend(m: re.Match) -> str:
        raw = m.group()
        w = clean_token(raw)
        true = words.get(w.lower())
        if true is None:
            return raw
        if w.isupper() and len(w) > 1:
            true = true.upper()
        elif w[:1].isupper() or not w[:1].isalpha() and w[1:2].isupper():
            true = true[:1].upper() + true[1:]
        return raw.replace(w, true, 1)

    return re.sub(r"\S+", mend, text)


def bigrams(texts: DataFrame, seconds: DataFrame) -> DataFrame:
    """(prev, word, k): how often the corpus has a word behind another, for the words of ``seconds``."""
    few = seconds.limit(200_001).count() <= 200_000
    known = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in seconds.collect()) if few else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = known.value
        n: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                ws = words_of(t)
                n.update((a, b) for a, b in zip(ws, ws[1:], strict=False) if wanted is None or b in wanted)
            if len(n) > 300_000:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["prev", "word", "k"])
                n = Counter()
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["prev", "word", "k"])

    raw = texts.select("text").mapInPandas(run, "prev string, word string, k bigint")
    return raw.groupBy("prev", "word").agg(F.sum("k").alias("k")).join(seconds, "word", "left_semi")


def repair(texts: DataFrame) -> DataFrame:
    """(src, row_id, repaired_text) of the texts with damage."""
    counts = cut(counted(texts))
    pairs = cut(damaged_words(counts))
    top = counts.join(pairs, "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON)
    common = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in top.select("word").collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str | None] = {}
        for pdf in batches:
            rows = []
            for s, r, t in zip(pdf["src"], pdf["row_id"], pdf["text"], strict=True):
                got = marks(t, common.value, memo)
                if any(k == "char" for k, _, _ in got):
                    ws = words_of(t)
                    before = {b: a for a, b in zip(ws, ws[1:], strict=False)}
                    got = [(k, w, before.get(w) if k == "char" else o) for k, w, o in got]
                rows += [(s, r, *x) for x in got]
            yield pd.DataFrame(rows, columns=["src", "row_id", "kind", "word", "other"])

    found = cut(texts.select("src", "row_id", "text").mapInPandas(run, "src string, row_id bigint, kind string, word string, other string"))
    char = found.where("kind = 'char'").select("src", "row_id", "word", F.coalesce("other", F.lit("")).alias("prev")).join(pairs.withColumnRenamed("true", "meant"), "word")
    context = bigrams(texts, pairs.select(F.col("true").alias("word")).distinct()).select("prev", F.col("word").alias("meant"), "k")
    char = char.join(context, ["prev", "meant"], "left")
    best = char.groupBy("src", "row_id", "word").agg(F.max_by("meant", F.struct(F.log1p("m") + 2 * F.log1p(F.coalesce("k", F.lit(0))), "meant")).alias("meant"))
    words = best.groupBy("src", "row_id").agg(F.collect_list(F.struct("word", "meant")).alias("words"))
    joined, compound = counts.select("word", F.col("n").alias("n_joined")), counts.select(F.col("word").alias("other"), F.col("n").alias("n_compound"))
    whole = found.where("kind = 'hyphen'").join(joined, "word", "left").join(compound, "other").where("n_compound > coalesce(n_joined, 0)")
    whole = whole.groupBy("src", "row_id").agg(F.collect_set("other").alias("compounds"))
    rows = found.where("kind != 'char'").select("src", "row_id").union(best.select("src", "row_id")).distinct()

    @F.pandas_udf("string")
    def mended(text: pd.Series, words: pd.Series, compounds: pd.Series) -> pd.Series:
        return pd.Series([rebuild(t, {} if w is None else {x["word"]: x["meant"] for x in w}, set() if c is None else set(c)) for t, w, c in zip(text, words, compounds, strict=True)], dtype=object)

    out = rows.join(texts, ["src", "row_id"]).join(words, ["src", "row_id"], "left").join(whole, ["src", "row_id"], "left")
    return out.select("src", "row_id", mended("text", "words", "compounds").alias("repaired_text"))
