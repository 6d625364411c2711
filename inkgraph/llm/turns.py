"""Problem 4: speech transcripts into clean, ordered speaker turns.

Method.  Each transcript's lines are parsed in whatever layout it has (labels with colons, dashes or tabs, time stamps,
caption cues, ``>>``, questions and answers).  Labels are normalised against the transcript's roster and, for what the
roster does not settle at once, against the rosters of the other transcripts of the case: labels and listed persons are
blocked by phonetic keys, and the labels of one form (surnames, initials, ...) are given to persons by an optimal
assignment over edit distances.  A label that fits a person of another transcript's roster better is a voice that is not
on the list.  Lexical noise (hesitations, sound notes, stutters) is stripped, turns are put in time order, turns without
words drop out and neighbouring turns of one speaker are joined.

Scale.  Parsing is one projection over Arrow batches whose result is cut and read by all that follows.  Cross-transcript candidates are an equi-join on (case, phonetic key)
of the *unsettled* labels with distinct listed persons, pre-aggregated on both sides, so a hot case meets only within its
phonetic blocks and only the best distance leaves the join.  Turn numbers are windows over one transcript, whose size is
that of a document.

Edge cases: null, blank and failed transcripts and transcripts without turns give no rows; without a participants list
every voice is ``unknown``; labels without words open no turn; equal time stamps keep the written order; turns without a
time stamp keep their place after the last stamped one; a label has by definition at most six words and 60 characters; repeated rows under new ids are worked on by themselves; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.canon import edit
from inkgraph.session import cut

TITLES = frozenset("""mr mrs ms miss mx dr prof officer ofc off deputy dep sheriff sergeant sgt detective det inspector insp lieutenant lt captain capt cpt chief
corporal cpl trooper agent major maj colonel col constable const commander cmdr investigator inv ro ri judge hon rev herr frau hr fr sr sra señor señora m mme""".split())  # fmt: skip
SUFFIXES = frozenset(("jr", "sr", "ii", "iii", "iv"))
STRANGER = re.compile(r"\b(?:un(?:known|identified|id|named)|voice|speaker|someone|somebody|other|off(?:screen|camera)|background|intercom|radio|operator|all|both|crowd|television)\b", re.I)
PARTICIPANTS = re.compile(r"(?im)^[^\S\n]*(?:participants|present|attendees|persons present)[^\S\n]*:[^\S\n]*(.*)$")
CUE = re.compile(r"^\s*(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\s*-->\s*\d")
VOICE = re.compile(r"^\s*<v(?:\.\S+)?\s+([^>]+)>(.*)$", re.S)
STAMP = re.compile(r"^\s*(?:>>\s*)?[\[(<]?(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)[\])>]?(?:\s*[-–|])?\s+(.*)$", re.S)
ANSWER = re.compile(r"^\s*([QA])\s*[.:)]\s*(.*)$", re.S)
PART = (re.compile(r"^([^:\t]{1,70}?)\s*:(?:\s+|$)(.*)$", re.S), re.compile(r"^([^\t]{1,70}?)\s*\t\s*(.*)$", re.S), re.compile(r"^(.{1,70}?)\s+[–—-](?:\s+|$)(.*)$", re.S))
NOTE = re.compile(r"\[[^\]\n]*\]|\(\((?:[^()\n]*)\)\)|\((?![^()\n]*\d)[^()\n@]*\)|\{[^}\n]*\}|<[^>\n]*>|\*[^*\n]+\*|[♪♫#]+")
OBFUSCATED = re.compile(r"\[\s*(?:at|dot)\s*\]|\(\s*(?:at|dot)\s*\)", re.I)
FILLER = r"(?:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m{2,}|a+h+|o+h+|m+h+m+|ähm?|euh|este)"
FILLED = re.compile(rf"(?i)(?<![\w'’@.-]){FILLER}(?:\.{{3}}|…|\s+[–—-](?=\s)|,)?(?![\w'’@-])")
STUTTER = re.compile(r"(?i)\b(\w{1,12})-\s+(?=\1)")


@lru_cache(maxsize=200_000)
def plain(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return s.translate(str.maketrans("ßøłđæœ", "solđao")).replace("’", "'")


@lru_cache(maxsize=200_000)
def person(line: str) -> tuple[tuple[str, ...], str]:
    """Name parts without titles, and the suffix, of a name or label."""
    words = [w.strip(".,'\"") for w in re.split(r"[\s,]+", plain(line).replace("/", "")) if w.strip(".,'\"")]
    suffix = ""
    if len(words) > 1 and words[-1] in SUFFIXES:
        suffix = words.pop()
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    return tuple(words), suffix


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A phonetic key: the consonant classes of a word after its first letter."""
    w = re.sub(r"[^a-z]", "", plain(word).replace("ph", "f").replace("ck", "k").replace("th", "t"))
    if not w:
        return ""
    code = w.translate(str.maketrans("bfpvcgjkqsxzdtlmnr", "111122222222334556", "aeiouyhw"))
    code = re.sub(r"(.)\1+", r"\1", code)
    return w[0] + code[:4]


def sounds(label: str) -> set[str]:
    """Keys under which a label may meet a person: those of its parts and of the parts with one letter dropped."""
    out = set()
    for w in person(label)[0]:
        if len(w) > 2:
            out.add(sound(w))
            out |= {sound(w[:i] + w[i + 1 :]) for i in range(min(len(w), 12))}
    return out - {""}


@lru_cache(maxsize=50_000)
def forms(line: str) -> dict[str, str]:
    """The ways in which a listed person may be called: form -> folded text."""
    words, suffix = person(line)
    if not words:
        return {}
    out = {"full": " ".join(words), "surname": words[-1]}
    if len(words) > 1:
        out |= {"initial": f"{words[0][0]} {words[-1]}", "first": words[0], "letters": words[0][0] + words[-1][0], "ends": f"{words[0]} {words[-1]}", "turned": f"{words[-1]} {' '.join(words[:-1])}"}
        if len(words) > 2:
            out["all"] = "".join(w[0] for w in words)
            out["last two"] = " ".join(words[-2:])
    if suffix:
        out["suffixed"] = f"{out['full']} {suffix}"
    return out


@lru_cache(maxsize=200_000)
def kind_of(label: str) -> tuple[str, str]:
    """(form, folded text) of a label."""
    words, suffix = person(label)
    tight = re.sub(r"[^a-z]", "", plain(label))
    if 1 < len(tight) <= 3 and re.fullmatch(r"(?:[^\W\d_]\.?\s?){2,3}", label.strip()) and (label.strip().isupper() or "." in label):
        return "letters", tight
    if suffix:
        return "suffixed", f"{' '.join(words)} {suffix}"
    return ("word" if len(words) == 1 else "name"), " ".join(words)


@lru_cache(maxsize=200_000)
def distance(label: str, line: str) -> float:
    """How badly a label fits a listed person: 0 fits exactly, above 3 not at all."""
    kind, text = kind_of(label)
    own = forms(line)
    if not own or not text:
        return 9.0
    if kind == "letters":
        return 0.0 if text in (own.get("letters"), own.get("all")) else 9.0
    if kind == "suffixed":
        if text == own.get("suffixed"):
            return 0.0
        base, mine = text.rsplit(" ", 1)[0], person(line)[1]
        if mine and mine != text.rsplit(" ", 1)[1]:
            return 9.0
        label_words = base
        best = min(_near(label_words, own[f]) for f in own if f != "letters")
        return best + (0.25 if not mine else 0.1)
    if kind == "word":
        best = min([_near(text, own["surname"]), *([0.5 + _near(text, own["first"])] if "first" in own else [])])
        return best
    return min(_near(text, own[f]) for f in own if f not in ("letters", "all", "surname", "first"))


def _near(a: str, b: str) -> float:
    if a == b:
        return 0.0
    most = 1 if len(b) < 5 else 2 if len(b) < 12 else 3
    d = edit(a, b, most)
    return float(d) if d <= most else 9.0


def matching(costs: list[list[float]], most: float = 3.0) -> dict[int, int]:
    """Row -> column: as many rows as fit at up to ``most``, at the least sum, by shortest augmenting paths."""
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    cols = range(len(costs[0]) if costs else 0)
    for _ in costs:
        far = {r: 0.0 for r in range(len(costs)) if r not in col_of}
        reach: dict[int, tuple[float, int]] = {}
        changed = True
        while changed:
            changed = False
            for r, d in list(far.items()):
                for c in cols:
                    if costs[r][c] > most or col_of.get(r) == c:
                        continue
                    x = d + costs[r][c]
                    if c not in reach or x < reach[c][0] - 1e-9:
                        reach[c] = (x, r)
                        changed = True
                        if (o := row_of.get(c)) is not None:
                            far[o] = x - costs[o][c]
        free = [(x, c) for c, (x, _) in reach.items() if c not in row_of]
        if not free:
            break
        c: int | None = min(free)[1]
        while c is not None:
            r = reach[c][1]
            row_of[c], col_of[r], c = r, c, col_of.get(r)
    return col_of


def assign(labels: list[str], roster: list[str]) -> dict[str, tuple[str | None, float]]:
    """Labels to listed persons at least total cost: label -> (line or None, distance).

    Among the labels of one form, spellings that fold to the same text are one voice and distinct voices go to distinct
    persons, as many of them as fit and at the least sum of distances.  A person more than one edit further off than the
    best is no choice: a misspelt name beside the right one is not another voice.  A voice for which no person is left is
    a variant of a label that has one, and gets the person that it fits best.
    """
    out: dict[str, tuple[str | None, float]] = {}
    voices: dict[str, dict[str, list[str]]] = {}
    for label in labels:
        if STRANGER.search(label):
            out[label] = (None, 9.0)
        else:
            kind, text = kind_of(label)
            voices.setdefault(kind, {}).setdefault(text, []).append(label)
    for same in voices.values():
        fits = {}
        for text in sorted(same):
            costs = [distance(same[text][0], line) for line in roster]
            if min(costs, default=9.0) <= 3:
                fits[text] = costs
            else:
                out |= {label: (None, 9.0) for label in same[text]}
        given = matching([[d if d <= min(costs) + 1 else 9.0 for d in costs] for costs in fits.values()])
        for n, (text, costs) in enumerate(fits.items()):
            i = given.get(n, costs.index(min(costs)))
            out |= {label: (roster[i], costs[i]) for label in same[text]}
    return out


KEPT = re.compile("\x00(\\d+)\x00")
RUNS = re.compile(r"\s+")
BEFORE_STOP = re.compile(r"\s+([,.;:?!])")
FRONT = re.compile(r"^[\s,;–—-]+")
#: Signs without which a text holds no note, and letters without which it holds no hesitation.
NOTE_SIGNS = re.compile(r"[\[({<*♪♫#]")
HESITATES = re.compile(r"(?i)\b(?:u+[hm]|e+[hr]|h+m|mm|ah|oh|mh|ä?hm|euh|este)")


def clean(text: str) -> str:
    """The words of a turn without hesitations, sound notes and stutters."""
    t = text
    if NOTE_SIGNS.search(t) is not None:
        kept: list[str] = []

        def keep(m: re.Match) -> str:
            kept.append(m.group())
            return f"\x00{len(kept) - 1}\x00"

        t = NOTE.sub(" ", OBFUSCATED.sub(keep, t))
        if HESITATES.search(t) is not None:
            t = FILLED.sub(" ", t)
        if "- " in t or "-\n" in t:
            t = STUTTER.sub("", t)
        if kept:
            t = KEPT.sub(lambda m: kept[int(m.group(1))], t)
    else:
        if HESITATES.search(t) is not None:
            t = FILLED.sub(" ", t)
        if "- " in t or "-\n" in t:
            t = STUTTER.sub("", t)
    t = BEFORE_STOP.sub(r"\1", RUNS.sub(" ", t))
    return FRONT.sub("", t).strip()


def has_words(text: str) -> bool:
    return any(c.isalnum() for c in text)


def seconds(stamp: str) -> float:
    return sum(float(x) * 60**i for i, x in enumerate(reversed(stamp.replace(",", ".").split(":"))))


def roster_of(text: str) -> tuple[list[str], dict[str, str], str]:
    """Listed persons, the letters of a question-and-answer list, and the text behind the list."""
    m = PARTICIPANTS.search(text)
    if m is None:
        return [], {}, text
    lines = [m.group(1)] if m.group(1).strip() else []
    rest = text[m.end() :]
    at = 0
    for piece in re.finditer(r"[^\n]*(?:\n|$)", rest):
        line = piece.group().strip()
        if not line:
            if lines or at > len(rest):
                break
            at = piece.end()
            if piece.end() >= len(rest):
                break
            continue
        lines.append(line)
        at = piece.end()
    roster, letters = [], {}
    for line in (x for part in lines for x in (part.split(";") if len(lines) == 1 else [part])):
        line = re.sub(r"^[-*•·\d.)\s]+(?=\D)", "", line)
        name = re.sub(r"\s*[(\[][^)\]]*[)\]]\s*", " ", line).strip()
        if not name:
            continue
        roster.append(name)
        if (q := re.search(r"[(\[]\s*([QA])\s*[)\]]", line)) is not None:
            letters[q.group(1)] = name
    return list(dict.fromkeys(roster)), letters, rest[at:]


def looks_like_label(label: str, roster: list[str], memo: dict[str, bool]) -> bool:
    label = label.strip()
    if label not in memo:
        memo[label] = _looks_like_label(label, roster)
    return memo[label]


def _looks_like_label(label: str, roster: list[str]) -> bool:
    if not label or len(label) > 60:
        return False
    if STRANGER.search(label) and len(label.split()) <= 3:
        return True
    words = [w for w in re.split(r"\s+", label) if w]
    if len(words) > 6 or any(c.isdigit() for c in label) or re.search(r"[?!\"“”]", label):
        return False
    if not all(w[0].isupper() or w[0] in "('" for w in words):
        return False
    if len(words) <= 4 and (len(words) > 1 or label.isupper()):
        return True
    return STRANGER.search(label) is None and any(distance(label, line) <= 3 for line in roster)


def raw_turns(text: str) -> tuple[list[str], dict[str, str], list[tuple[float | None, str, str]]]:
    """Roster, question-and-answer letters, and (second, label, text) of each written turn."""
    roster, letters, body = roster_of(text)
    memo: dict[str, bool] = {}
    lines = body.split("\n")
    n_cue = sum(CUE.match(x) is not None for x in lines) if "-->" in body else 0
    n_arrow = sum(x.lstrip().startswith(">>") for x in lines)
    stamps = [STAMP.match(x) for x in lines] if not n_cue else []
    n_stamp = sum(x is not None for x in stamps)
    n_answer = sum(ANSWER.match(x) is not None for x in lines) if letters else 0
    n_tab = sum("\t" in x.strip() for x in lines)
    labels = 0
    seps = PART
    if not (n_cue or n_answer):
        counts = []
        heads = [st.group(2) if n_stamp > 1 and st is not None else x for x, st in zip(lines, stamps, strict=True)]
        heads = [y.lstrip("> \t") for y in heads] if n_arrow else heads
        for p, sign in zip(PART, (":", "\t", None), strict=True):
            hits = 0
            for y in heads:
                m = p.match(y) if sign is None or sign in y else None
                hits += m is not None and looks_like_label(m.group(1), roster, memo)
            counts.append(hits)
        labels = max(counts)
        seps = (PART[counts.index(labels)],) if labels else ()
        if n_tab and counts[1] >= max(2, 0.5 * labels):
            seps = (PART[1],)
    turns: list[list] = []
    now: float | None = None
    for at, line in enumerate(lines):
        if not line.strip():
            continue
        if n_cue:
            if (m := CUE.match(line)) is not None:
                now = seconds(m.group(1))
                continue
            if (m := VOICE.match(line)) is not None:
                turns.append([now, m.group(1).strip(), re.sub(r"</v>\s*$", "", m.group(2))])
                continue
            m = PART[0].match(line)
            if m is not None and looks_like_label(m.group(1), roster, memo):
                turns.append([now, m.group(1).strip(), m.group(2)])
                continue
        elif n_answer and (m := ANSWER.match(line)) is not None:
            turns.append([None, m.group(1), m.group(2)])
            continue
        else:
            stamp, rest = None, line
            if n_stamp > 1 and (m := stamps[at]) is not None:
                stamp, rest = seconds(m.group(1)), m.group(2)
            arrow = rest.lstrip().startswith(">>") or line.lstrip().startswith(">>")
            if (n_stamp < 2 or stamp is not None) and (n_arrow < 2 or arrow):
                rest = rest.lstrip("> \t") if arrow else rest
                hit = None
                for p in seps:
                    m = p.match(rest)
                    if m is not None and looks_like_label(m.group(1), roster, memo):
                        hit = (m.group(1), m.group(2))
                        break
                if hit is None and stamp is not None and (not labels or labels < 2) and looks_like_label(rest, roster, memo):
                    hit = (rest, "")
                if hit is not None:
                    turns.append([stamp, hit[0].strip(), hit[1]])
                    continue
        if turns:
            turns[-1][2] += "\n" + line
    return roster, letters, [tuple(t) for t in turns]


PARSED = "id bigint, case_id string, turns array<struct<at:double,n:int,label:string,speaker:string,words:string>>, labels array<struct<label:string,d:double,keys:array<string>>>, roster array<struct<line:string,keys:array<string>>>"


def parse(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(turns, unsettled labels, roster) of a transcript.

    Turns: (second, number, label, speaker, words), those without words left out; labels: those whose best person of the
    roster is not spelt so, with the distance and their phonetic keys; roster: persons with their phonetic keys.
    """
    roster, letters, written = raw_turns(text)
    table = assign(list(dict.fromkeys(label for _, label, _ in written)), roster)
    turns, last = [], -1.0
    for n, (stamp, label, said) in enumerate(written):
        last = stamp if stamp is not None else last
        words = clean(said)
        if has_words(words):
            turns.append((last, n, label, letters.get(label) or table[label][0] or "unknown", words))
    labels = [(label, d, sorted(sounds(label))) for label, (line, d) in table.items() if line is not None and d > 0 and label not in letters]
    return turns, labels, [(line, sorted({sound(w) for w in person(line)[0] if len(w) > 2} - {""})) for line in roster]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(key, case, *parse(t)) for key, case, t in zip(pdf["id"], pdf["case_id"], pdf["text"], strict=True)]
        yield pd.DataFrame(rows, columns=["id", "case_id", "turns", "labels", "roster"])


def strangers(parsed: DataFrame) -> DataFrame:
    """(id, label) of labels that fit a person of another roster of the case better than any of their own."""
    labels = parsed.select("id", "case_id", F.inline("labels"))
    # labels and persons of many transcripts are compared once: the same spelling meets a block once a case
    persons = parsed.select("case_id", F.inline("roster")).select("case_id", "line", F.explode("keys").alias("key")).distinct()
    once = labels.select("case_id", "label", F.explode("keys").alias("key")).distinct()

    @F.pandas_udf("double")
    def fits(label: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([distance(a, b) for a, b in zip(label, line, strict=True)])

    best = once.join(persons, ["case_id", "key"]).select("case_id", "label", fits("label", "line").alias("other")).groupBy("case_id", "label").agg(F.min("other").alias("other"))
    return labels.select("id", "case_id", "label", "d").join(best, ["case_id", "label"]).where(F.col("other") < F.col("d")).select("id", "label").distinct()


def speaker_turns(interviews: DataFrame, key: str = "id", case: str = "case_id", text: str = "interview_text") -> DataFrame:
    """(id, turn_no, speaker, turn_text) of each clean turn, in the order spoken."""
    src = interviews.select(F.col(key).alias("id"), F.col(case).cast("string").alias("case_id"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    parsed = cut(src.mapInPandas(_parse, PARSED))  # the texts are parsed once; turns, labels and rosters are taken from that
    turns = parsed.select("id", F.inline("turns"))
    odd = strangers(parsed).withColumn("odd", F.lit(True))
    turns = turns.join(odd, ["id", "label"], "left").withColumn("speaker", F.when(F.col("odd"), "unknown").otherwise(F.col("speaker")))
    w = Window.partitionBy("id").orderBy("at", "n")
    turns = turns.withColumn("new", (F.lag("speaker").over(w).isNull() | (F.lag("speaker").over(w) != F.col("speaker"))).cast("int"))
    turns = turns.withColumn("turn_no", F.sum("new").over(w).cast("int"))
    out = turns.groupBy("id", "turn_no").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("at", "n", "words"))).alias("parts"))
    return out.select("id", "turn_no", "speaker", F.array_join("parts.words", " ").alias("turn_text"))
