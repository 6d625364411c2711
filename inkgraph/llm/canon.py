"""Problem 1: mapping freely entered values to a canonical list.

Method.  A multi-pattern automaton (Aho-Corasick) is built over the canonical names and their aliases, each with its
inflected forms.  Aliases come from the reference list itself (the phrase that an entry's gloss says) and from a thesaurus
of common relation words (``SENSES``, a parameter): a sense that holds an entry's name, or else its gloss, lends it its
phrases.  A value is folded (compatibility forms, look-alike letters, case, separators, typing marks, articles) and scanned,
as words and in one piece; among the embedded mentions the longest non-overlapping ones win, and the longest is taken when
hardly more than function words is left outside it.  What the automaton leaves goes to token-set similarity: the tokens of
the value are held against the tokens of the phrases without regard to order or number, each as a typo, an abbreviation or
the same word; candidates come from inverted indexes over tokens and over their pairs of letters, never from a scan of all
phrases.  The best phrase above the threshold wins, otherwise the value is reported as having no entry (``ref_id`` 0).

Scale.  The reference list is small by definition (checked, ``MAX_ENTRIES``: beyond it an error, nothing is dropped) and
travels with the closure.  Rows are mapped where they are scanned: no shuffle, one Arrow pass, distinct values of a batch
are solved once and kept in a memo per worker, so hot values cost nothing and skew does not matter.

Edge cases: null values are not rows of the result of :func:`map_values` (they stay null with ``ref_id`` null in
:func:`canonicalize`); empty, blank or sign-only values give 0; ties go to the canonical name before an alias, then to the
smaller ref_id; very long values are scanned whole; an empty reference list gives 0 everywhere; a null gloss gives no alias;
extra columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 10_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝвмнткАВЕКМНОРСТУХІЈЅЗοαερτυνικΟΑΕΡΤΥΝΙΚΗΜΒΖ",
                          "aeopcyxijshdqwbmhtkABEKMHOPCTYXIJS3oaeptuvikOAEPTYNIKHMBZ")
NOTE = re.compile(r"\[[^\]]*\]|\((?:prob|sic|unk|cf|unconf|conf)[^)]*\)|#\s*\d+\s*$|\?+\s*$|^\s*(?:rel|edge|type|pred|verb|relation|edge_type|predicate)\s*[:=]+", re.I)
CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z])")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
FUNCTION_WORDS = frozenset("a an the of to by in on at with for was were is are be been being has have had did it its".split())

#: A thesaurus of relations and actions in records: phrases of one sense, in base form; forms of "be" may be left out.
SENSES = (
    "participate in; take part in; be involved in; join in; be part of; be participant of; be participant in",
    "be located at; be situated at; be found at; be found at place; be at; be in place; location is; place is",
    "occur on; happen on; take place on; date is",
    "state; say; say for the record; declare; tell; make a statement; give a statement; give statement; statement by",
    "observe; see; notice; witness; spot; watch",
    "be acquainted with; know; be an acquaintance of; be a friend of; be familiar with",
    "be dispatched to; be sent to; be sent out to; be deployed to",
    "dispatch; send; send out; deploy",
    "be interviewed by; be questioned by; be interrogated by",
    "interview; question; interrogate; hold an interview with",
    "contact; call; call up; phone; ring; telephone; get in touch with; reach out to",
    "arrive at; arrival at; come to; get to; reach; reach the scene; pull up to; show up at",
    "reside at; live at; live in; dwell at; lodge at; be domiciled at; have home at; home address is",
    "be employed by; work for; work at; be an employee of; be on payroll of; be on the staff of; be hired by",
    "employ; hire; give work to; have on staff; have on payroll",
    "be parent of; be mother of; be father of; be mum of; be dad of; have child; parent",
    "be child of; be son of; be daughter of; have parent",
    "be sibling of; be brother of; be sister of; be twin of; have sibling",
    "be married to; be married with; be husband of; be wife of; be spouse of; be wed to; marry",
    "be a partner of; be boyfriend of; be girlfriend of; date with",
    "examine; inspect; look over; check over; carry out an exam of; carry out an examination of",
    "transport; haul; convey; carry away; drive away; drive away with; move by vehicle",
    "co occur with; co occurs with; co occurrence; cooccurrence; appear with; appear together with; be seen together with",
    "report; make a report; file a report; report to police; notify police",
    "discover; find; come upon; come across; stumble on; stumble upon; uncover",
    "secure; lock down; seal off; cordon off; make safe",
    "identify; id; recognize; recognise; put a name to; name",
    "purchase; buy; pay for",
    "threaten; menace; make threats to; make threats against",
    "sell; vend; offer for sale",
    "own; possess; be owner of; have title to",
    "attack; assault; set upon; beat up",
    "kill; murder; slay; cause the death of",
    "injure; wound; hurt; harm",
    "arrest; detain; apprehend; take into custody",
    "steal; rob; make off with; take without leave",
    "visit; call on; drop in on; pay a visit to",
    "attend; be present at; sit in on",
    "accompany; go along with; escort",
    "pursue; chase; follow; run after",
    "search; comb through; go through",
    "collect; gather; pick up; seize",
    "leave; depart from; go away from; set out from",
    "enter; go into; step into; get into",
    "receive; be given; get from",
    "give; hand over; pass to; provide",
    "deny; dispute; refuse to admit",
    "confirm; corroborate; verify; bear out",
    "assist; help; aid; lend a hand to",
    "suspect; distrust; have doubts about",
    "describe; depict; give an account of",
    "remove; take away; clear out",
    "meet; come together with; get together with",
    "study at; be a student of; be enrolled at",
    "teach; instruct; be a teacher of",
    "manage; supervise; be in charge of; be head of",
    "treat; give care to; look after",
)

#: Irregular forms of the verbs above (fixed facts of English).
IRREGULAR = {
    "take": "took taken taking", "find": "found finding", "come": "came coming", "see": "saw seen seeing", "get": "got gotten getting",
    "send": "sent sending", "buy": "bought buying", "be": "is was were been being are", "make": "made making", "have": "has had having",
    "hold": "held holding", "pay": "paid paying", "put": "putting", "know": "knew known knowing", "say": "said says saying",
    "ring": "rang rung", "id": "id'd ided", "give": "gave given giving", "marry": "married marries marrying", "identify": "identified identifies identifying",
}


@lru_cache(maxsize=100_000)
def fold(value: str) -> str:
    s = unicodedata.normalize("NFKC", value).translate(LOOKALIKE)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    last = None
    while last != s:
        last, s = s, NOTE.sub(" ", s)
    s = CAMEL.sub(" ", s).lower().replace("’", "'")
    words = WORD.findall(s)
    return " ".join([w for w in words if w not in ("a", "an", "the")] or words)


def forms(word: str) -> set[str]:
    """The inflected forms of an English verb by rule, the word itself included."""
    out = {word}
    base = word
    for b, irregular in IRREGULAR.items():
        if word == b or word in irregular.split():
            return {b, b + "s", *irregular.split()}
    if len(word) < 4:
        return out
    for end in ("ing", "ed", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            base = word[: -len(end)]
            out |= {base, base + "e"}
            if base.endswith("i"):
                out.add(base[:-1] + "y")
            if len(base) > 3 and base[-1] == base[-2]:
                out.add(base[:-1])
            break
    for b in list(out):
        e = b[:-1] if b.endswith("e") else b
        y = b[:-1] + "i" if b.endswith("y") else b
        out |= {e + "ing", e + "ed", y + ("ed" if y != b else ""), b + "s", y + "es" if y != b else b + "s"}
        if re.fullmatch(r".*[^aeiou][aeiou][^aeiouwxy]", b):
            out |= {b + b[-1] + "ed", b + b[-1] + "ing"}
    return out


def skeleton(s: str) -> str:
    return re.sub(r"[aeiou]", "", s)


@lru_cache(maxsize=200_000)
def letters(s: str) -> int:
    """The set of letters as bits; strings at edit distance d differ in at most 2 d letters."""
    m = 0
    for c in s:
        m |= 1 << (ord(c) & 63)
    return m


def edit(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` when it is larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        d = len(a) or len(b)
        return min(d, most + 1)
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = one[j - 1] + (x != y)
            if one[j] < d:
                d = one[j] + 1
            if now[j - 1] < d:
                d = now[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and two[j - 2] < d:
                d = two[j - 2] + 1
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return min(one[-1], most + 1)


def clipped(token: str, full: str) -> bool:
    """Whether a token is an abbreviation of a word: its beginning, or its letters in order from the first one."""
    token = token.replace("'", "")
    if not token or token[0] != full[0] or len(token) >= len(full):
        return False
    if full.startswith(token) and len(token) >= 3:
        return True
    if len(token) < 3:
        return False
    rest = iter(full)
    return all(c in rest for c in token)


def inflected(phrase: str) -> set[str]:
    """A folded phrase with the forms of its first word; what stands behind a "be" also alone."""
    words = fold(phrase).split()
    out = {" ".join([f, *words[1:]]) for f in forms(words[0])} if words else set()
    if len(words) > 1 and words[0] == "be":
        out.add(" ".join(words[1:]))
    return out


GLOSS_HEAD = re.compile(r"^(?:(?:an?|the|two|one|something|another(?:'s)?)\s+\w+(?:\s+or\s+\w+)?|something)\s+")
GLOSS_TAIL = re.compile(r"\s+(?:(?:an?|the|each|another|its|their)\s+\w+(?:\s+or\s+\w+)*(?:\s+by\s+.*)?|something(?:\s+\w+)?|somewhere|elsewhere|another|together|closely|unknown)$")


def gloss_phrase(gloss: str | None) -> str:
    """What a gloss says of the relation, without the nouns it stands between ("a person lives at a place": lives at)."""
    s = " ".join((gloss or "").lower().split())
    if GLOSS_HEAD.match(s) and len(s.split()) > 3:
        s = GLOSS_HEAD.sub("", s, count=1)
    return fold(GLOSS_TAIL.sub("", s))


class NearStrings:
    """Strings within an edit distance, through an inverted index over pairs of letters.

    A string of n letters has n + 1 pairs (with its ends); an edit changes at most three of them, so strings at distance d
    share at least max(n, m) + 1 - 3 d pairs, which is at least one for the distances asked here.
    """

    def __init__(self, strings: list[str]):
        self.strings = sorted(set(strings))
        self.index: dict[str, list[int]] = {}
        for i, s in enumerate(self.strings):
            for g in set(self.grams(s)):
                self.index.setdefault(g, []).append(i)

    @staticmethod
    def grams(s: str) -> list[str]:
        t = f"^{s}$"
        return [t[i : i + 2] for i in range(len(t) - 1)]

    def __call__(self, s: str, most: int) -> list[tuple[int, str]]:
        """(distance, string) of the strings at most ``most`` edits away."""
        own = set(self.grams(s))
        slack = len(s) + 1 - len(own)  # distinct pairs may be fewer than pairs: repeats are forgiven
        shared = Counter(chain.from_iterable(self.index.get(g, ()) for g in own))
        out = []
        for i, n in shared.items():
            p = self.strings[i]
            if abs(len(p) - len(s)) <= most and n + slack >= max(len(p), len(s)) + 1 - 3 * most and (d := edit(s, p, most)) <= most:
                out.append((d, p))
        return out


def most_edits(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 9 else 3


class CanonMatcher:
    """Maps one value to the ref_id of an entry of a kind, 0 for none.  ``entries``: (ref_id, canonical name, gloss)."""

    def __init__(self, entries: list[tuple], senses: tuple[str, ...] = SENSES):
        import ahocorasick

        self.patterns: dict[str, tuple[int, int]] = {}  # folded phrase -> (0 canon / 1 inflected / 2 alias, ref_id)
        self.compact: dict[str, tuple[int, int]] = {}  # the same in one piece, with and without articles
        self.canon: list[tuple[int, list[str]]] = []
        listed = [[x.strip() for x in group.split(";") if x.strip()] for group in senses]
        holding: dict[str, list[int]] = {}
        for i, group in enumerate(listed):
            for form in {f for x in group for f in inflected(x)}:
                holding.setdefault(form, []).append(i)
        for ref_id, name, *gloss in sorted(entries, key=lambda e: e[0]):
            own, said = fold(name), gloss_phrase(gloss[0] if gloss else None)
            self.canon.append((ref_id, own.split()))
            self._add(name, 0, ref_id)
            for form in inflected(own):
                self._add(form, 1, ref_id)
            found = holding.get(own) or [i for form in sorted(inflected(own)) for i in holding.get(form, ())] or holding.get(said) or []
            aliases = [x for i in dict.fromkeys(found) for x in listed[i]] + ([said] if " " in said else [])
            for alias in aliases:
                self._add(alias, 2, ref_id)
                for form in inflected(alias):
                    self._add(form, 2, ref_id)
        self.automaton = ahocorasick.Automaton()
        for p, v in self.patterns.items():
            self.automaton.add_word(f" {p} ", (len(p), v))
        for p, v in self.compact.items():
            self.automaton.add_word(f"\x01{p}\x01", (len(p), v))
        if self.patterns:
            self.automaton.make_automaton()
        self.skeletons: dict[str, set[int]] = {}
        for ref_id, words in self.canon:
            for first in forms(words[0]) if words else ():
                self.skeletons.setdefault(skeleton("".join([first, *words[1:]])), set()).add(ref_id)
        # inverted indexes: phrases by their tokens, tokens by their pairs of letters and by their first letter
        self.by_token: dict[str, set[str]] = {}
        for p in self.patterns:
            for w in p.split():
                self.by_token.setdefault(w, set()).add(p)
        self.own_tokens = {w for p, (rank, _) in self.patterns.items() if rank < 2 for w in p.split()}
        self.near_token = NearStrings(list(self.by_token))
        self.near_skeleton = NearStrings(list(self.skeletons))
        self.near_whole = NearStrings([p for p, (rank, _) in self.compact.items() if len(p) > (5 if rank == 2 else 3)])  # short aliases are taken as they stand
        self.by_first: dict[str, list[str]] = {}
        for w in self.by_token:
            self.by_first.setdefault(w[0], []).append(w)
        self.memo: dict[str, int] = {}

    def _add(self, phrase: str, rank: int, ref_id: int) -> None:
        p = fold(phrase)
        if not p:
            return
        if p not in self.patterns or (rank, ref_id) < self.patterns[p]:
            self.patterns[p] = (rank, ref_id)
        for one in (p.replace(" ", ""), "".join(WORD.findall(phrase.lower()))):
            if one and (one not in self.compact or (rank, ref_id) < self.compact[one]):
                self.compact[one] = (rank, ref_id)

    def __call__(self, value: str) -> int:
        if value not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[value] = self.solve(value)[0]
        return self.memo[value]

    def solve(self, value: str) -> tuple[int, str]:
        """(ref_id, route): mention, token set or none."""
        s = fold(value)
        if not s or not self.patterns or s.isdigit():
            return 0, "none"
        if ref_id := self.mention(s):
            return ref_id, "mention"
        ref_id = self.token_set(s)
        return ref_id, "token set" if ref_id else "none"

    def mention(self, s: str) -> int:
        """The entry of the longest non-overlapping mention, where little else is said; 0 otherwise."""
        tight = s.replace(" ", "")
        pieces = [f" {s} ", f"\x01{tight}\x01", *([f"\x01{tight[3:]}\x01"] if tight.startswith("the") else [])]
        hits = []
        for k, hay in enumerate(pieces):
            for end, (n, (rank, ref_id)) in self.automaton.iter(hay):
                hits.append((-n if not k else -len(s), rank, ref_id, end - n if not k else 0, n if not k else len(s)))
        hits.sort()
        taken: list[tuple[int, int, int]] = []
        for _, _, ref_id, start, n in hits:
            if all(start >= e or start + n <= b for b, e, _ in taken):
                taken.append((start, start + n, ref_id))
        if not taken:
            return 0
        winner = taken[0][2]
        left = list(s)
        covered = 0
        for b, e, ref_id in taken:
            if ref_id == winner:
                left[b:e] = " " * (e - b)
                covered += e - b
        rest = [w for w in "".join(left).split() if w not in FUNCTION_WORDS]
        return winner if not rest or covered >= 10 and covered >= 3 * sum(map(len, rest)) else 0

    def alike(self, t: str) -> dict[str, float]:
        """Tokens of the phrases that a token may stand for, with their likeness."""
        out = {}
        if len(t) >= 4:
            out = {w: 1 - d / len(w) for d, w in self.near_token(t, 1 if len(t) < 6 else 2) if len(w) > 3 and d <= (2 if len(w) > 5 else 1) and (len(w) > 5 or w in self.own_tokens)}
        elif len(t) > 1:
            out = {w: 0.5 for d, w in self.near_token(t, 1) if d and len(w) < 4}
        for w in self.by_first.get(t[0], ()):
            if clipped(t, w) and (w.startswith(t) or skeleton(t[1:]) == t[1:]):  # cut off, or without its vowels
                out[w] = max(out.get(w, 0.0), 0.6 + 0.4 * len(t) / len(w))
        if t in self.by_token:
            out[t] = 1.0
        return out

    def token_set(self, s: str) -> int:
        """The entry of the phrase most like the value as a set of tokens, the value in one piece being a set of one."""
        tight = s.replace(" ", "")
        scores: list[tuple[float, int, int]] = []  # -likeness, rank, ref_id
        for t in dict.fromkeys((tight, tight[3:] if tight.startswith("the") and len(tight) > 6 else tight)):
            if skeleton(t) == t.replace("'", "") and len(t) > 2:  # written without its vowels
                hit = self.skeletons.get(t) or set()
                if len(hit) != 1 and len(t) > 4:
                    hit = {r for _, k in self.near_skeleton(t, 1) for r in self.skeletons[k]}
                if len(hit) == 1:
                    return next(iter(hit))
            for d, p in self.near_whole(t, most_edits(len(t))):
                if d <= max(1, (len(p) + 1) // 3) and d / len(p) <= 0.34:
                    scores.append((d / len(p) - 1, *self.compact[p]))
        tokens = s.split()
        like = [self.alike(t) for t in tokens]
        weigh = lambda w: len(w) * (0.3 if w in FUNCTION_WORDS else 1.0)
        if len(tokens) > 1 or not scores:
            for p in {p for d in like for w in d if w not in FUNCTION_WORDS for p in self.by_token[w]}:
                words = p.split()
                pairs = sorted(((d.get(w, 0.0), i, j) for i, d in enumerate(like) for j, w in enumerate(words) if w in d), key=lambda x: (-x[0], x[1], x[2]))
                by_i: dict[int, int] = {}
                got = 0.0
                for x, i, j in pairs:
                    if i not in by_i and j not in by_i.values():
                        by_i[i] = j
                        got += x * weigh(words[j])
                total = sum(map(weigh, words)) + sum(weigh(t) for i, t in enumerate(tokens) if i not in by_i)
                if got >= 0.6 * total:
                    scores.append((-got / total, *self.patterns[p]))
        if scores:
            scores.sort()
            return scores[0][2]
        t = tight[3:] if tight.startswith("the") else tight
        if len(t) >= 5:  # an abbreviation written in one piece
            hit = {r for r, words in self.canon for f in forms(words[0]) if (w := "".join([f, *words[1:]]))[0] == t[0] and w[-1] == t[-1] and 0.45 * len(w) <= len(t) and clipped(t, w)}
            if len(hit) == 1:
                return next(iter(hit))
        return 0


def canonicalize(df: DataFrame, value: str, kind: str, ref: DataFrame, senses: tuple[str, ...] = SENSES, out: str = "ref_id") -> DataFrame:
    """``df`` with a column ``out``: the ref_id of the entry of ``kind`` that ``value`` means, 0 for none, null for null."""
    gloss = F.col("gloss") if "gloss" in ref.columns else F.lit(None).cast("string")
    rows = ref.where(F.col("kind") == kind).select("ref_id", "canon", gloss.alias("gloss")).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list of more than {MAX_ENTRIES} entries")
    entries = [(int(r[0]), r[1], r[2]) for r in rows if r[1] is not None]

    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = CanonMatcher(entries, senses)
        for s in batches:
            codes, uniques = pd.factorize(s)
            solved = pd.array([matcher(u) for u in uniques] + [pd.NA], dtype="Int32")
            yield pd.Series(solved[codes], index=s.index)

    return df.withColumn(out, F.pandas_udf(mapped, "int")(F.col(value).cast("string")))


def map_values(df: DataFrame, src: str, row_id: str, value: str, kind: str, ref: DataFrame) -> DataFrame:
    """Rows (src, row_id, ref_id) of the values that are not letter for letter a canonical name of their kind."""
    exact = F.array(*[F.lit(r[0]) for r in ref.where((F.col("kind") == kind) & F.col("canon").isNotNull()).select("canon").limit(MAX_ENTRIES + 1).collect()])
    typed = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(value).alias("value"))
    typed = typed.where(F.col("value").isNotNull() & ~F.array_contains(exact, F.col("value")))
    return canonicalize(typed, "value", kind, ref).select(F.lit(src).alias("src"), "row_id", "ref_id")
