"""Relations from parsed sentences: subject-verb-object triples and token patterns.

A parse is an array of token structs (text, lemma, pos, dep, ent, head); ``head`` is the index of the token's head, -1 at
the root.  Subtrees need closure over that array, which Catalyst has no expression for, so these are Arrow UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions import fixed
from inkgraph.operators.relations import verb_forms

TOKEN = "struct<text:string,lemma:string,pos:string,dep:string,ent:string,head:int>"
TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"
SUBJECTS, OBJECTS = ("nsubj", "nsubjpass"), ("dobj", "pobj", "attr", "dative")
MATCHES = "array<struct<subject:string,predicate:string,object:string,relation_type:string>>"


def _person(t: dict) -> bool:
    return t["ent"] in ("PERSON", "ROLE")


def _lemma(*words: str) -> Callable[[dict], bool]:
    return lambda t: t["lemma"] in words


def _word(word: str) -> Callable[[dict], bool]:
    return lambda t: t["text"].lower() == word


#: Token patterns: relation, [(what a token must be, how often: 1 once, + once or more, ? at most once)].
PATTERNS = (
    ("HAS_PARENT", [(_person, "1"), (_lemma("be"), "1"), (_lemma("bear"), "1"), (_word("to"), "1"), (_person, "+")]),
    ("HAS_PARENT", [(_person, "1"), (lambda t: t["pos"] == "PART" and t["text"].lower() == "'s", "1"), (_word("parent"), "+"), (_lemma("be"), "1"), (_person, "+")]),
    ("HAS_SIBLING", [(_person, "1"), (_word("and"), "1"), (_person, "1"), (lambda t: t["pos"] == "VERB" and t["lemma"] == "get", "1"), (_word("along"), "1"), (_word("well"), "1")]),
    ("HAS_SIBLING", [(_person, "1"), (_word("and"), "1"), (_person, "1"), (_lemma("be"), "1"), (_word("sister"), "+")]),
    ("INTERVIEWED", [(_person, "1"), (_lemma("interview"), "1"), (_person, "+")]),
    ("ASKED", [(_person, "1"), (_lemma("ask"), "1"), (_person, "?")]),
    ("STATED", [(_person, "1"), (_lemma("say", "state", "report", "claim"), "1")]),
    ("TOLD", [(_person, "1"), (_lemma("tell"), "1"), (_person, "1")]),
)
#: What stands as predicate where a pattern has no verb of its own.
PHRASES = {1: "parents were", 2: "got along well", 3: "are sisters"}


def _subtree(tokens: list[dict], root: int) -> str:
    below = {root}
    grown = True
    while grown:
        more = {i for i, t in enumerate(tokens) if t["head"] in below} - below
        grown = bool(more)
        below |= more
    return " ".join(tokens[i]["text"] for i in sorted(below))


def triples_of(tokens: list[dict]) -> list[dict]:
    """(subject, predicate, object) of the root verb of a sentence, none where a part is missing."""
    out = []
    for i, t in enumerate(tokens):
        if t["head"] != -1 or t["pos"] not in ("VERB", "AUX"):
            continue
        kids = [k for k, x in enumerate(tokens) if x["head"] == i]
        subject = next((k for k in kids if tokens[k]["dep"] in SUBJECTS), None)
        obj = next((k for k in kids if tokens[k]["dep"] in OBJECTS), None)
        if obj is None:
            obj = next((g for k in kids if tokens[k]["dep"] == "prep" for g, x in enumerate(tokens) if x["head"] == k and x["dep"] == "pobj"), None)
        if subject is not None and obj is not None:
            out.append({"subject": _subtree(tokens, subject), "predicate": (t["lemma"] or t["text"]).strip(), "object": _subtree(tokens, obj)})
    return out


def ends(pattern: list, tokens: list[dict], at: int) -> list[int]:
    """Every place where a match of the pattern that begins at ``at`` may end."""
    places = [at]
    for fits, often in pattern:
        then: list[int] = []
        for i in places:
            if often == "?":
                then.append(i)
            while i < len(tokens) and fits(tokens[i]):
                i += 1
                then.append(i)
                if often != "+":
                    break
        places = list(dict.fromkeys(then))
    return places


def matches_of(tokens: list[dict]) -> list[dict]:
    """Relations that token patterns state, all matches of each, with the inverse of those that have one.

    Parents give HAS_CHILD for every token of the object, siblings the same turned; who asks, states, tells or interviews
    must be a subject, who is told or interviewed an object of the verb; what is asked or stated is the match itself.
    """
    out: list[dict] = []
    for n, (relation, pattern) in enumerate(PATTERNS):
        for start in range(len(tokens)):
            for end in ends(pattern, tokens, start):
                span = tokens[start:end]
                people = [t for t in span if _person(t)]
                doers, targets = [t["text"] for t in people if t["dep"] == "nsubj"], [t["text"] for t in people if t["dep"] == "dobj"]
                verb = next((t["text"] for t in span if any(t["lemma"] == v for v in ("bear", "interview", "ask", "say", "state", "report", "claim", "tell"))), "")
                whole = " ".join(t["text"] for t in span)
                if relation == "HAS_PARENT":
                    subject, objects = people[0]["text"], [t["text"] for t in people[1:]]
                    out += [{"subject": o, "predicate": "has child", "object": subject, "relation_type": "HAS_CHILD"} for o in objects]
                    found = (subject, PHRASES.get(n, verb), " and ".join(objects))
                elif relation == "HAS_SIBLING":
                    a, b = people[0]["text"], people[1]["text"]
                    out.append({"subject": b, "predicate": "has sibling", "object": a, "relation_type": relation})
                    found = (a, PHRASES[n], b)
                elif relation in ("INTERVIEWED", "TOLD"):
                    found = (" and ".join(doers), verb, " and ".join(targets))
                else:
                    found = (" and ".join(doers), verb, whole)
                if all(found):
                    out.append({"subject": found[0], "predicate": found[1], "object": found[2], "relation_type": relation})
    return out


TOKENS = re.compile(r"'s\b|\w+(?:[-’]\w+)*|[^\w\s]")
PREPOSITIONS = frozenset("at in on to of by from with for about into near after before under over through toward".split())
STOPS = frozenset(",;:.!?()“”\"")


def shallow_of(text: str) -> list[dict]:
    """A shallow parse by rule, the default where no parser is plugged in: the first listed verb of the first clause that has
    one is the root, the words before it its subject, those behind it its object or those of its preposition."""
    words = TOKENS.findall(text)
    tokens = [{"text": w, "lemma": FORMS.get(w.lower(), w.lower()), "pos": "PUNCT" if w in STOPS else "PART" if w == "'s" else "ADP" if w.lower() in PREPOSITIONS else "PROPN" if w[:1].isupper() and i else "NOUN", "dep": "dep", "ent": "", "head": -1} for i, w in enumerate(words)]
    for m in RULER.finditer(text):
        at = len(TOKENS.findall(text[: m.start()]))
        for k in range(at, min(len(tokens), at + len(TOKENS.findall(m.group())))):
            tokens[k]["ent"] = next(label for p, label in fixed.RULER if re.fullmatch(p, m.group()))
    root = next((i for i, t in enumerate(tokens) if i and t["lemma"] in VERBS and tokens[i - 1]["pos"] not in ("PUNCT", "ADP")), None)
    if root is None:
        return tokens
    tokens[root].update(pos="AUX" if tokens[root]["lemma"] == "be" else "VERB", dep="ROOT")
    lo = next((i + 1 for i in range(root - 1, -1, -1) if tokens[i]["pos"] == "PUNCT"), 0)
    hi = next((i for i in range(root + 1, len(tokens)) if tokens[i]["pos"] == "PUNCT"), len(tokens))
    for i, t in enumerate(tokens):
        t["head"] = -1 if i == root else root
    _phrase(tokens, lo, root, root, "nsubj")
    if root + 1 < hi and tokens[root + 1]["pos"] == "ADP":
        tokens[root + 1]["dep"] = "prep"
        _phrase(tokens, root + 2, hi, root + 1, "pobj")
    else:
        stop = next((i for i in range(root + 1, hi) if tokens[i]["pos"] == "ADP"), hi)
        _phrase(tokens, root + 1, stop, root, "attr" if tokens[root]["lemma"] == "be" else "dobj")
    return tokens


def _phrase(tokens: list[dict], lo: int, hi: int, head: int, dep: str) -> None:
    """Makes the last word of a phrase its head, the others hang on it."""
    if lo < hi:
        for i in range(lo, hi - 1):
            tokens[i]["head"] = hi - 1
        tokens[hi - 1].update(head=head, dep=dep)


FORMS = {f: v for v in ["be", *fixed.VERB_TYPES] for f in verb_forms(v)}
VERBS = frozenset(["be", *fixed.VERB_TYPES]) - frozenset(fixed.NOUN_PREDICATES)
RULER = re.compile(r"\b(?:" + "|".join(p for p, _ in sorted(fixed.RULER, key=lambda r: -len(r[0]))) + r")\b")


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(parses: pd.Series) -> pd.Series:
        return pd.Series([[] if p is None else f(p if isinstance(p, str) else list(p)) for p in parses], dtype=object)

    return run


def triples(tokens: Column | str) -> Column:
    return _udf(triples_of, TRIPLES)(tokens)


def matches(tokens: Column | str) -> Column:
    return _udf(matches_of, MATCHES)(tokens)


def shallow(text: Column | str) -> Column:
    """The tokens of a sentence by the rules of :func:`shallow_of`."""
    return _udf(shallow_of, f"array<{TOKEN}>")(text)


def attach(sentences: DataFrame, text: str, parser: Callable[[str], list[dict]] = shallow_of) -> DataFrame:
    """Sentences with their ``tokens`` by a parser, the ``root_index`` and whether there are dependencies at all."""
    out = sentences.withColumn("tokens", _udf(parser, f"array<{TOKEN}>")(text))
    root = F.array_position(F.transform("tokens", lambda t: t["dep"] == "ROOT"), True) - 1
    return out.withColumns({"root_index": F.when(root >= 0, root.cast("int")), "has_dependencies": F.size("tokens") > 0})
