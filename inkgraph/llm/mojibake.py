"""Problem 10: text that was decoded with the wrong encoding.

Method: noisy-channel decoding.  The channel is a pair (encoding the bytes were in, encoding they were read in).  Every
damaged span is turned back into its byte lattice: each character is one byte of the encoding it was read in, a
replacement character (U+FFFD) is a wildcard for lost bytes.  Paths through the lattice that are well formed in the true
encoding are the candidates; UTF-8 sequences without lost bytes cannot overlap and are read as they stand.  Of single-byte
channels a word wins by the word frequencies of the corpus when it is said more often than the text as it stands, or lies
on the best path of a Viterbi search over the words of its text, whose states are the channels.  Lost bytes are filled by the most frequent corpus word that fits their number and all that survived.

Scale.  One Python pass over the texts finds what is certain by form (UTF-8 sequences, multi-byte runs, C1 controls,
replacement characters) and gives the distinct words with letters outside ASCII, a small share of the text.  Word counts
are a map-side combined aggregation over all documents; candidates are made per distinct word, and joined on the word,
so nothing is broadcast and no list of documents is collected.  A document goes to one row; nothing is grouped by
source, language or case, so a hot key makes no hot task.

Edge cases: null and blank texts are never damaged; texts without characters outside ASCII are skipped at once;
replacement characters that no corpus word fits, or beside which no letter
survived, stay in the restored text (``restored`` false); decomposed accents and
foreign scripts are no damage; repeated rows give repeated judgements under their own ids; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.session import cut

#: Encodings in which UTF-8 bytes are often read.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866")
CYRILLIC = frozenset(("cp1251", "koi8_r", "cp866"))
CYRILLIC_LETTER = re.compile("[\u0400-\u045f]")
#: (read as, true) pairs of single-byte encodings, judged by word frequencies.
WORD_CHANNELS = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1253"), ("cp1252", "cp1256"), ("cp1252", "cp874"), ("cp1252", "cp1255"), ("cp1252", "iso8859_5"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"),
    ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "iso8859_5"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"),
    ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("cp1257", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp850", "cp437"),
)
#: (read as, true) pairs with a multi-byte true encoding, judged by line.
LINE_CHANNELS = (("cp1252", "gb18030"), ("cp1252", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "big5"), ("cp1252", "euc_kr"), ("mac_roman", "gb18030"), ("mac_roman", "cp932"), ("cp437", "gb18030"), ("cp437", "cp932"), ("cp1251", "gb18030"))

#: What entering a channel costs in a text, as a logarithm of document counts.
ENTER = 2.0
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
C1 = re.compile(r"[\x80-\x84\x86-\x9f]")
EDGE = "\t \n\r.,;:!?\"'()[]{}<>/|*#-–—…“”„‘’«»‹›¿¡"
WIDE = re.compile(r"[぀-ヿ一-鿿가-힣]")
#: Characters that a reading may give: letters and marks of living scripts and common punctuation.
LATIN = re.compile("[\u00a0-\u017f\u0192\u0218-\u021b\u02c6\u02dc\u2010-\u2044\u20ac\u2122]+")
OTHER = re.compile(r"[Ά-ώЀ-џҐґא-ת،-ْ٪-٬ऀ-ॿก-๛　-ヿ㐀-䶿一-鿿가-힣＀-￯]+")


def as_bytes(s: str, codec: str, gap: bytes | None = None) -> bytes | None:
    """The bytes that ``codec`` read as ``s``; undefined bytes are read as C1 controls, other signs as ``gap``."""
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for c in s:
            try:
                out += c.encode(codec)
            except UnicodeEncodeError:
                if ord(c) <= 255:
                    out.append(ord(c))
                elif gap is None:
                    return None
                else:
                    out += gap
        return bytes(out)


def read_utf8(run: str, codec: str) -> tuple[str, int, int] | None:
    """The best path through a run of characters: (reading, characters won, sequences of other scripts).

    Without lost bytes UTF-8 sequences cannot overlap, so every path is a choice of sequences read or left.  A U+FFFD or
    a character that is no byte ends a sequence; sequences with lost bytes are left to the words of the corpus.
    """
    raw = as_bytes(run, codec, b"\0")
    if raw is None or len(raw) != len(run):
        return None
    out, at, won, foreign = [], 0, 0, 0
    for m in UTF8.finditer(raw):
        try:
            c = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        latin = LATIN.fullmatch(c) is not None or "\x80" <= c <= "\x9f"  # C1: read wrongly twice
        if not latin and OTHER.fullmatch(c) is None and not (len(m.group()) == 4):
            continue
        out += [run[at : m.start()], c]
        at = m.end()
        won += m.end() - m.start()
        foreign += not latin
    return ("".join(out) + run[at:], won, foreign) if won else None


@lru_cache(maxsize=len(UTF8_READ_AS))
def pair_of(codec: str) -> re.Pattern:
    """What a UTF-8 sequence begins with when ``codec`` reads it: a sign of a leading byte and one of a byte that carries on."""
    sign = lambda lo, hi: "".join(re.escape(c) for b in range(lo, hi) for c in {bytes([b]).decode(codec, "ignore") or chr(b), chr(b)})
    return re.compile(f"[{sign(0xC2, 0xF5)}][{sign(0x80, 0xC0)}]")


def by_form(text: str) -> tuple[str, set[str]]:
    """What is certain by form alone: (text with those spans restored, kinds of damage)."""
    kinds: set[str] = set()
    while True:  # read wrongly once or more often: each round makes the text shorter
        runs = {r for r in NON_ASCII.findall(text) if len(r) > 1}
        best, most, name = {}, 0, ""
        for codec in UTF8_READ_AS:
            pair = pair_of(codec)
            found = {run: got for run in runs if pair.search(run) is not None and (got := read_utf8(run, codec)) is not None}
            if not found:
                continue
            foreign = sum(f for _, _, f in found.values())
            cyrillic = codec in CYRILLIC
            fixes = {}
            for run, (reading, won, f) in found.items():
                if won < (0.75 if f or cyrillic else 0.5) * (len(run) - run.count("�")) or f and foreign < 3:  # one odd pair is no script
                    continue
                fixes[run] = reading
            total = sum(found[r][1] for r in fixes)
            if cyrillic and total < 0.75 * sum(len(r) for r in runs if CYRILLIC_LETTER.search(r)):  # true Cyrillic beside it
                continue
            if codec not in ("cp1252", *CYRILLIC) and total < 0.3 * sum(map(len, runs)):  # chance sequences in another damage
                continue
            if total > most:
                best, most, name = fixes, total, codec
        if not best:
            break
        kinds.add(f"utf-8 read as {name}")
        text = NON_ASCII.sub(lambda m, best=best: best.get(m.group(), m.group()), text)
    lines = []
    for line in text.split("\n"):
        high = sum(len(x) for x in NON_ASCII.findall(line))
        if high >= 4 and high >= 0.5 * len(line) and not WIDE.search(line):
            line = read_line(line, kinds)
        lines.append(line)
    text = "\n".join(lines)
    if "�" in text:
        kinds.add("lost bytes")
    if C1.search(text):
        kinds.add("control characters")
        text = C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "ignore") or m.group(), text)
    return text, kinds


def read_line(line: str, kinds: set[str]) -> str:
    """A line of bytes of a multi-byte encoding; the reading with the most common ideographs and syllables."""
    best, score = line, 0.0
    for codec, true in LINE_CHANNELS:
        raw = as_bytes(line, codec)
        if raw is None:
            continue
        try:
            reading = raw.decode(true)
        except UnicodeDecodeError:
            continue
        wide = [c for c in reading if ord(c) > 127]
        if not wide:
            continue
        common = 0.0
        for c in wide:
            if "぀" <= c <= "ヿ" or c in "。、「」，！？：；（）“”…—":
                common += 1.0
            elif "一" <= c <= "鿿":
                gb = c.encode("gb2312", "ignore")
                common += 0.9 if gb and gb[0] < 0xD8 else 0.45
            elif "가" <= c <= "힣":
                common += 0.8
        if (x := common / len(wide)) > max(0.85, score):
            best, score = reading, x
            kinds_now = f"{true} read as {codec}"
    if score:
        kinds.add(kinds_now)
    return best


def words_outside_ascii(text: str) -> list[str]:
    """Distinct words with characters outside ASCII in alphabetic scripts (no ideographs, Thai, Arabic or Indic), as they come."""
    out: dict[str, None] = {}
    for w in text.split():
        if not w.isascii():
            w = w.strip(EDGE)
            if w and not w.isascii() and not re.search(r"[֐-႟ᜀ-῿⺀-￯]", w.replace("�", "")):
                out[w] = None
    return list(out)


def one_script(s: str) -> bool:
    letters = [c for c in s if c.isalpha()]
    cyr = sum("Ѐ" <= c <= "ӿ" for c in letters)
    return bool(letters) and cyr in (0, len(letters))


@lru_cache(maxsize=100_000)
def through(word: str) -> tuple[tuple[int, str, str], ...]:
    """(channel, reading, the word in it) of a word through the single-byte channels."""
    out = []
    for n, (codec, true) in enumerate(WORD_CHANNELS):
        raw = as_bytes(word, codec)
        if raw is None:
            continue
        try:
            c = raw.decode(true)
        except UnicodeDecodeError:
            continue
        full, c = c, c.strip(EDGE)
        if not c or c == word or not one_script(c) or not all(x.isalpha() or x in "'’-.º°ª" for x in c):
            continue
        crossed = any("Ͱ" <= x <= "ۿ" for x in c) != any("Ͱ" <= x <= "ۿ" for x in word)
        if (crossed or any("Ѐ" <= x <= "ӿ" for x in c)) and sum(x.isalpha() for x in c) < 3:
            continue
        out.append((n, full, c))
    return tuple(out)


def readings(word: str) -> list[str]:
    """Other readings of a word through the single-byte channels."""
    return sorted({c for _, _, c in through(word)})


def best_path(words: list[tuple[str, int, dict[str, int]]]) -> list[tuple[str, str]]:
    """(word, fix) on the likeliest path through the channels: Viterbi search over the words of one text.

    ``words``: (word, documents with it, reading: documents with it).  A state is a channel, or none; a channel is
    entered at a cost that a few words must outweigh, and carries words that the corpus knows no better or not at all.
    """
    score, back = {-1: 0.0}, []
    for word, n, known in words:
        asis, other = log(n), {c: (full, x) for c, full, x in through(word)}
        top = max(score, key=lambda c: (score[c], -c))
        then, came = {}, {}
        for c in {-1, *score, *other}:
            enter = score[top] - (ENTER if c >= 0 else 0.0)
            came[c], base = (c, score[c]) if score.get(c, enter - 1) >= enter else (top, enter)
            then[c] = base + (log(known.get(other[c][1], 1)) if c in other else asis)
        back.append((came, other))
        score = then
    out, c = [], max(score, key=lambda c: (score[c], c >= 0, -c))
    for (word, _, _), (came, other) in zip(reversed(words), reversed(back), strict=True):
        if c in other:
            out.append((word, other[c][0]))
        c = came[c]
    return out[::-1]


def hole_key(word: str) -> str:
    """A word with every run outside ASCII (lost or not) as one hole."""
    return re.sub(r"[^\x00-\x7f]+", "�", word)


def block_keys(word: str) -> list[str]:
    """Keys under which a lost word may meet whole ones: its ASCII letters, else surviving signs, three in a row if there are."""
    hole = hole_key(word)
    if any(c.isalpha() for c in hole.replace("�", "")):
        return [hole]
    if "�" in word:
        kept = [x for x in re.findall(r"[^\x00-\x7f�]+", word) if any(c.isalpha() for c in x)]
        size = min(3, max(map(len, kept), default=0))
        return sorted({hole + x[i : i + size] for x in kept for i in range(len(x) - size + 1)})
    return sorted({hole + word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)})


def fits(word: str, whole: str) -> int:
    """How many letters a whole word puts into the holes of a lost one, 0 if it does not fit.

    What survived stays as it is, and a letter takes one to as many U+FFFD as it has bytes, or one sign for each of its
    UTF-8 bytes as an encoding reads it, of which U+FFFD is any.
    """
    return max(through_lattice(word, whole, codec) for codec in UTF8_READ_AS)


@lru_cache(maxsize=10_000)
def signs(c: str, codec: str) -> tuple[str, ...]:
    """The UTF-8 bytes of a character, each as ``codec`` reads it."""
    return tuple(bytes([b]).decode(codec, "ignore") or chr(b) for b in c.encode("utf-8", "replace"))


def through_lattice(word: str, whole: str, codec: str) -> int:
    """The letters lost on the path through the byte lattice of ``word`` that spells ``whole``, 0 if none does."""
    at = {0: 0}  # place in the lost word: fewest letters lost on the way there
    for c in whole:
        then: dict[int, int] = {}
        for i, n in at.items():
            if word[i : i + 1] == c:
                then[i + 1] = min(n, then.get(i + 1, n))
            for k in range(1, len(c.encode("utf-8", "replace")) + 1 if c > "\x7f" else 1):
                if word[i : i + k] != "�" * k:
                    break
                then[i + k] = min(n + 1, then.get(i + k, n + 1))
            read = signs(c, codec) if c > "\x7f" else ()
            part = word[i : i + len(read)]
            if len(part) == len(read) > 1 and all(x in (y, "�") for x, y in zip(part, read, strict=True)):
                lost = n + ("�" in part)
                then[i + len(read)] = min(lost, then.get(i + len(read), lost))
        at = then
    return at.get(len(word), 0)


def analyse(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per text: doc_id, fixed (text after the repairs that are certain by form), kinds, words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                fixed, kinds = by_form(t)
                rows.append((key, fixed if kinds else None, sorted(kinds), words_outside_ascii(fixed)))
            yield pd.DataFrame(rows, columns=["doc_id", "fixed", "kinds", "words"])

    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return src.mapInPandas(run, "doc_id bigint, fixed string, kinds array<string>, words array<string>")


def word_fixes(seen: DataFrame) -> DataFrame:
    """(word, fix, kind) of damaged words, by corpus word frequencies.  ``seen``: (doc_id, word), distinct."""
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))

    @F.pandas_udf("array<string>")
    def other(words: pd.Series) -> pd.Series:
        return words.map(readings)

    @F.pandas_udf("array<string>")
    def blocks(words: pd.Series) -> pd.Series:
        return words.map(block_keys)

    @F.pandas_udf("bigint")
    def fit(words: pd.Series, wholes: pd.Series) -> pd.Series:
        return pd.Series([fits(a, b) for a, b in zip(words, wholes, strict=True)], dtype="int64")

    known = counts.where(~F.col("word").contains("�"))
    cand = known.withColumn("fix", F.explode(other("word")))
    freq = known.select(F.col("word").alias("fix"), F.col("n").alias("m"))
    single = cand.join(freq, "fix").where((F.col("m") >= 3) & (F.col("m") > 2 * F.col("n")))
    single = single.groupBy("word").agg(F.max_by("fix", F.struct("m", "fix")).alias("fix")).withColumn("kind", F.lit("single-byte encodings"))
    # lost bytes: the most frequent word that fits what is left; with less left than lost, only if no other fits
    left = F.length(F.regexp_replace("word", r"[^\p{L}\p{M}]", ""))
    lost = counts.where(F.col("word").contains("�")).select("word", F.explode(blocks("word")).alias("block"))
    whole = known.select(F.col("word").alias("fix"), F.col("n").alias("m"), F.explode(blocks("word")).alias("block"))
    fit_by = lost.join(whole, "block").drop("block").distinct().withColumn("gone", fit("word", "fix")).where("gone > 0")
    filled = fit_by.groupBy("word").agg(F.max_by(F.struct("fix", "gone"), F.struct("m", "fix")).alias("best"), F.count("*").alias("fitting"))
    filled = filled.where((left >= F.col("best.gone")) | (F.col("fitting") == 1)).select("word", "best.fix", F.lit("lost bytes").alias("kind"))
    return single.unionByName(filled)


def doc_fixes(rows: DataFrame) -> DataFrame:
    """(doc_id, word, fix, kind): what the counts say of a word anywhere, and what the path through its text says."""
    seen = rows.select("doc_id", F.posexplode("words").alias("pos", "word"))
    sure = seen.select("doc_id", "word").join(word_fixes(seen), "word").select("doc_id", "word", "fix", "kind")
    counts = seen.where(~F.col("word").contains("�")).groupBy("word").agg(F.count("*").alias("n"))

    @F.pandas_udf("array<string>")
    def other(words: pd.Series) -> pd.Series:
        return words.map(readings)

    @F.pandas_udf("array<struct<word string, fix string>>")
    def path(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"word": w, "fix": f} for w, f in best_path([(x["word"], x["n"], {k["fix"]: k["m"] for k in x["known"]} if x["known"] is not None else {}) for x in t])])

    known = counts.withColumn("fix", F.explode(other("word"))).join(counts.select(F.col("word").alias("fix"), F.col("n").alias("m")), "fix")
    known = known.groupBy("word").agg(F.max((F.col("m") > F.col("n")).cast("int")).alias("gain"), F.collect_list(F.struct("fix", "m")).alias("known"))
    words = seen.join(counts, "word").join(known, "word", "left")
    texts = words.groupBy("doc_id").agg(F.max("gain").alias("gain"), F.array_sort(F.collect_list(F.struct("pos", "word", "n", "known"))).alias("t")).where("gain = 1")
    told = texts.select("doc_id", F.inline(path("t"))).withColumn("kind", F.lit("single-byte encodings"))
    return sure.unionByName(told.join(sure.select("doc_id", "word"), ["doc_id", "word"], "left_anti"))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id of every document of which at least part was decoded with the wrong encoding."""
    rows = cut(analyse(df, doc_id, text).select("doc_id", "kinds", "words"))  # read by several branches below
    worded = doc_fixes(rows).select("doc_id")
    return rows.where(F.size("kinds") > 0).select("doc_id").union(worded).distinct()


def restore(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds, restored_text, restored) of the damaged documents; restored: nothing damaged is left."""
    rows = cut(analyse(df, doc_id, text))
    per_doc = doc_fixes(rows).groupBy("doc_id").agg(F.collect_set(F.struct("word", "fix")).alias("fixes"), F.collect_set("kind").alias("more"))
    hit = rows.join(per_doc, "doc_id", "left").where((F.size("kinds") > 0) | F.col("more").isNotNull())
    hit = hit.join(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")

    @F.pandas_udf("string")
    def apply(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        out = []
        for t, fx in zip(texts, fixes, strict=True):
            table = {} if fx is None else {f["word"]: f["fix"] for f in fx}
            if table:
                t = re.sub(r"\S+", lambda m: m.group().replace(w, table[w]) if (w := m.group().strip(EDGE)) in table else m.group(), t)
            out.append(t)
        return pd.Series(out)

    hit = hit.withColumn("restored_text", apply(F.coalesce("fixed", "text"), "fixes"))
    return hit.select("doc_id", F.array_sort(F.array_union("kinds", F.coalesce("more", F.array().cast("array<string>")))).alias("kinds"), "restored_text", (~F.col("restored_text").rlike("[�\u0080-\u0084\u0086-\u009f]")).alias("restored"))
