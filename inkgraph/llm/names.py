"""Problem 3: variant spellings of the names of persons and organisations.

Method: noisy-channel attribution.  The distinct spellings of a case are ranked by a prior (how common their parts are in
the whole corpus and how often the case writes them so); the well-ranked full ones are candidate canonical forms.  The
channel gives the likelihood of a spelling under a canonical form as the sum of what its parts cost: typos (edit distance,
only where one side is rare in the corpus, so that relatives with different given names stay apart), nicknames, initials,
turned order, missing spaces, misread digits, abbreviations and acronyms, titles, remarks.  Each spelling is attached to
the form of maximum posterior above it; following the attachments to their roots gives the entities.

Scale.  Rows are pre-aggregated to distinct spellings with counts; what a spelling is by itself is worked out once for the
corpus.  Candidates come from an equi-join on (case, key), where a key holds the beginning or end of one part together with
the initial of the other, so that even a case with a third of all rows falls into small blocks; only spellings, counts and
ranks travel through it.  There are no all-pairs within a case, and nothing is collected.  Roots are found by pointer jumping
over spellings, which takes log(depth) joins of aggregated rows, cut by checkpoints.  :func:`classes` gives one row per row
with its class; :func:`find` spells the pairs out.

Edge cases: null and blank names are no mentions; rows without mentions go by their canonical name; evidence, places and
times are left out by the type the corpus mostly gives that spelling, whatever a single row says; a surname alone, with a
title or without, that fits several persons goes to the likeliest, and without a title it must fit letter for letter; an
acronym has two to five letters; ties go to the better-ranked and then the first spelling in order; repeated
rows share their spelling's entity; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm import canon
from inkgraph.llm.canon import clipped
from inkgraph.session import cut

edit = lru_cache(maxsize=50_000)(canon.edit)  # names are made of few parts, and rows come case by case

#: Short forms of English given names in common use (fixed values): given name -> short forms.
NICKNAMES = {
    "abigail": "abby gail abbie", "alexandra": "alex sandra lexi sasha alexa", "benjamin": "ben benny benji", "christopher": "chris kit topher", "deborah": "deb debbie debby", "dominic": "dom nick nico",
    "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth lizzie betty eliza bess libby", "frederick": "fred freddie freddy rick", "gregory": "greg gregg", "harriet": "hattie harry", "henrietta": "etta hettie hetty henri", "ignacio": "nacho iggy",
    "jonathan": "jon john johnny jonny nathan", "josephine": "jo josie josey", "judith": "judy jude", "jurgen": "juergen jorg", "katherine": "kate kathy kat katie kathie kit kay", "lawrence": "larry lawrie laurie", "leonard": "len lenny leo lennie",
    "margaret": "maggie meg peggy marge margie greta", "matilda": "tilly mattie tilda matty", "nicholas": "nick nicky nico", "oliver": "ollie olly", "patricia": "pat patty trish tricia patsy", "quentin": "quent quint", "robert": "rob bob bobby robbie bert", "rosalind": "roz ros rosie linda",
    "susannah": "sue susie suzy susan sukey", "theodore": "ted theo teddy", "timothy": "tim timmy", "victoria": "vicky tori vicki vic", "vincent": "vince vin vinny", "william": "will bill billy liam willie", "winifred": "winnie fred freda win", "yolanda": "yoli lola yola", "zachary": "zach zack zac",
    "francois": "frank fran", "james": "jim jimmy jamie", "richard": "rich rick dick", "michael": "mike mick mikey", "thomas": "tom tommy", "joseph": "joe joey", "charles": "charlie chuck", "anthony": "tony", "daniel": "dan danny", "david": "dave", "steven": "steve", "andrew": "andy drew", "samuel": "sam", "barbara": "barb", "catherine": "cathy kate", "rebecca": "becky", "jennifer": "jen jenny", "virginia": "ginny",
}
SHORT: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts.split():
        SHORT.setdefault(_s, set()).add(_full)

ORG_WORDS = frozenset("""school sch elementary elem elementry bank svgs savings center centre ctr medical med control ctrl animal anml company towing twg hardware hdwe supply college coll community comm county sheriff
sheriffs office off ofc hospital university univ department dept agency association corporation corp inc llc ltd police court church clinic services service unit institute foundation group""".split())
ORG_NOISE = frozenset("the and & of co inc llc ltd na corp plc".split())
TITLES = frozenset("mr mrs ms mx miss dr prof officer ofc deputy dep sheriff sergeant sgt detective det inspector insp lieutenant lt captain capt chief agent trooper r/o r/i ro ri judge rev sir madam".split())
SUFFIX = {"sr": "sr", "senior": "sr", "jr": "jr", "junior": "jr", "ii": "jr", "iii": "iii", "iv": "iv"}
OCR = str.maketrans("0158!|@$", "olsbilas")
ARTICLE = re.compile(r"^(?:an?|the|some|two|three|four|several|one|his|her|their)\s+[a-z]", re.I)


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().replace("’", "'")
    return s.translate(str.maketrans("ßøłđ", "sold"))


@lru_cache(maxsize=20_000)
def parse(name: str) -> tuple:
    """(kind, first, middle, last, suffix, tight, parts, acronym, hint) of a spelling; kind: person, initial, surname, glued, org, acronym, none."""
    none = ("none", "", "", "", "", "", [], "", "")
    raw = unicodedata.normalize("NFKC", name).replace("_", " ").strip()
    hint = ""
    m = re.search(r"[(\[]([^)\]]*)[)\]]", raw)
    if m:
        hint = fold(m.group(1)).strip()
        raw = (raw[: m.start()] + " " + raw[m.end() :]).strip()
    raw = re.split(r"\b(?:aka|a\.k\.a\.?|alias|also known as|née|formerly)\b", raw, flags=re.I)[0]
    raw = raw.strip(" .,;:-–—*\"'“”?!#")
    if not raw or not any(c.isalpha() for c in raw):
        return none
    if re.fullmatch(r"[A-Z](?:[A-Z&]|\.[A-Z]|\.)*[A-Z]\.?", raw) and 2 <= sum(c.isalpha() for c in raw) <= 5 or re.fullmatch(r"[a-z]{3,4}", raw) and not re.search("[aeiou]", raw):
        return ("acronym", "", "", "", "", "", [], fold(re.sub(r"[^A-Za-z]", "", raw)), hint)
    if ARTICLE.match(raw) and not any(w.strip(".,'") in ORG_WORDS for w in fold(raw).split()):
        return none
    low = fold(raw)
    if any(c.isdigit() for c in low):
        low = re.sub(r"\S*[a-z]\S*", lambda m: m.group().translate(OCR), low) if re.search(r"[a-z]", low) else low
        if any(c.isdigit() for c in low):
            return none
    comma = low.count(",") >= 1
    pieces = [p.strip() for p in low.split(",") if p.strip()]
    words = [[w for w in (re.sub(r"[^a-z'/&-]", "", x).strip("'-") for x in re.split(r"[\s.]+", p)) if w] for p in pieces]
    flat = [w.replace("'s", "s").replace("'", "") for p in words for w in p]
    if any(w in ORG_WORDS for w in flat) and len(flat) > 1:
        groups = [[w.replace("'s", "s").replace("'", "") for w in p] for p in words]
        groups = [g for g in ([w for w in p if w not in ORG_NOISE or w == "co" and "sheriffs" in flat] for p in groups) if g]
        if len(groups) == 2 and len(groups[1]) == 1 and groups[1][0] not in ORG_WORDS:
            groups = [groups[1], groups[0]]
        parts = [w.replace("-", "") for g in groups for w in g]
        parts = ["county" if w == "co" else w for w in parts if len(w) > 1] or parts
        return ("org", "", "", "", "", "".join(parts), parts, "".join(w[0] for w in parts), hint)
    suffix = ""
    for p in words:
        for w in list(p):
            if w.replace(".", "") in SUFFIX and len(flat) > 2:
                suffix = SUFFIX[w]
                p.remove(w)
    titled = False
    for p in words:
        while p and p[0] in TITLES and sum(map(len, words)) > 1:
            p.pop(0)
            titled = True
    words = [p for p in words if p]
    if not words:
        return none
    if comma and len(words) >= 2:
        last, given = "".join(words[0]), words[1]
    else:
        given, last = words[0][:-1], words[0][-1]
        if len(last) <= 2 and len(given) == 1 and len(given[0]) > 3:
            last, given = given[0], [last]  # a surname before initials
    last = last.replace("-", "").replace("'", "")
    given = [w.replace("-", "").replace("'", "") for w in given if w]
    if not last or len(last) < 2:
        return none
    if not given:
        if titled:
            return ("surname", "", "", last, suffix, last, [last], "", hint)
        return ("glued", "", "", last, suffix, last, [last], "", hint)
    first, middle = given[0], "".join(given[1:])
    if len(first) <= 2 and comma or len(first) == 1:
        return ("initial", first[0], first[1:2] or middle[:1], last, suffix, first + last, [last], "", hint)
    return ("person", first, middle, last, suffix, first + last, [first, last], "", hint)


def keys(p: tuple) -> tuple[list[str], list[str]]:
    """(keys under which a spelling looks for forms, keys under which it is found as a form)."""
    kind, first, _, last, _, tight, parts, acronym, hint = p
    ask: set[str] = set()
    found: set[str] = set()
    if kind == "person":
        for a in {first} | SHORT.get(first, set()):
            for x, y in ((a, last), (last, a)):
                ask |= {f"{x[:4]}/{y[0]}", f"{x[-6:]}/{y[0]}"}
        found = set(ask) | {f"g{tight}", f"g{last}{first}", f"o{last[:4]}", f"o{last[-6:]}"}
        ask = ask | {f"g{tight}"}
    elif kind == "initial":
        ask = {f"{last[:4]}/{first}", f"{last[-6:]}/{first}"}
    elif kind == "surname":
        ask = {f"o{last[:4]}", f"o{last[-6:]}"}
    elif kind == "glued":  # both parts run together, or a surname alone
        ask = {f"g{last}", f"o{last[:4]}", f"o{last[-6:]}"}
    elif kind == "org":
        place, rest = parts[0], parts[1] if len(parts) > 1 else "_"
        ask = {f"x{acronym}", f"y{place[:4]}{rest[0]}", f"y{place[-5:]}{rest[0]}"}
        found = set(ask)
    elif kind == "acronym":
        ask = {f"x{acronym}"}
    return sorted(ask), sorted(found)


def given_cost(a: str, b: str, na: int, nb: int) -> float:
    """Cost of a given name written for another."""
    if a == b:
        return 0.0
    if SHORT.get(a, set()) & ({b} | SHORT.get(b, set())) or a in SHORT.get(b, set()):
        return 0.3
    if len(a) >= 3 and b.startswith(a) or len(b) >= 3 and a.startswith(b):
        return 0.6
    d = edit(a, b, 2)
    if d > (1 if min(len(a), len(b)) < 5 else 2) or min(na, nb) > 3 and 5 * min(na, nb) > max(na, nb):
        return 9.0  # two names that people have
    return 1.0 * d


def last_cost(a: str, b: str, na: int, nb: int) -> float:
    if a == b:
        return 0.0
    d = edit(a, b, 2)
    if d > (1 if min(len(a), len(b)) < 6 else 2) or min(na, nb) > 5 and 4 * min(na, nb) > max(na, nb):
        return 9.0
    return 1.0 * d


def org_cost(q: dict, c: dict) -> float:
    a, b = list(q["parts"]), list(c["parts"])
    if len(a) != len(b):
        if sorted(a) == sorted(b):
            return 0.2
        short, long = (a, b) if len(a) < len(b) else (b, a)
        if len(long) - len(short) == 1 and long[: len(short)] == short and long[-1] in ("company", "co", "inc"):
            return 0.5
        return 1.0 if edit("".join(a), "".join(b), 1) <= 1 else 9.0
    total = 0.0
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        if clipped(x, y) or clipped(y, x):
            total += 0.3
            continue
        d = edit(x, y, 2)
        if d > (1 if min(len(x), len(y)) < 6 else 2):
            return 1.0 if sorted(a) == sorted(b) else 9.0
        if i == 0 and min(q["last_n"], c["last_n"]) > 5 and 4 * min(q["last_n"], c["last_n"]) > max(q["last_n"], c["last_n"]):
            return 9.0
        total += d
    return total


def cost(q: dict, c: dict) -> float:
    """What the channel asks for the spelling ``q`` of the canonical form ``c``; 9 and more: not a spelling of it."""
    kq, kc = q["kind"], c["kind"]
    if (kq in ("org", "acronym")) != (kc == "org"):
        return 9.0
    if kq == "acronym":
        fits = q["acronym"] == c["acronym"]
        place = c["parts"][0] if len(c["parts"]) else ""
        return 9.0 if not fits or q["hint"] and place and edit(q["hint"], place, 2) > 2 and not place.startswith(q["hint"]) else 0.8
    if kq == "org":
        return org_cost(q, c)
    extra = 0.0
    if q["suffix"] and c["suffix"] and q["suffix"] != c["suffix"]:
        return 9.0
    if bool(q["suffix"]) != bool(c["suffix"]):
        extra += 0.3
    if kq == "glued":
        if q["last"] in (c["first"] + c["last"], c["last"] + c["first"], c["first"] + c["middle"] + c["last"]):
            return extra + 0.2
        return extra + 1.3 if q["last"] == c["last"] else 9.0
    if kq == "surname":
        d = last_cost(q["last"], c["last"], q["last_n"], c["last_n"])
        return extra + 1.0 + d
    if kq == "initial":
        d = last_cost(q["last"], c["last"], q["last_n"], c["last_n"])
        if q["first"] != c["first"][0] and not any(f[0] == q["first"] for f in SHORT.get(c["first"], ())):
            return 9.0
        if q["middle"] and c["middle"] and q["middle"][0] != c["middle"][0]:
            extra += 1.5
        return extra + 0.5 + d
    if q["middle"] and c["middle"] and q["middle"][0] != c["middle"][0]:
        extra += 1.5
    straight = given_cost(q["first"], c["first"], q["first_n"], c["first_n"]) + last_cost(q["last"], c["last"], q["last_n"], c["last_n"])
    turned = 0.2 + given_cost(q["last"], c["first"], q["last_n"], c["first_n"]) + last_cost(q["first"], c["last"], q["first_n"], c["last_n"])
    whole = 9.0
    if edit(q["tight"], c["tight"], 1) <= 1 and q["first"][0] == c["first"][0]:
        whole = 1.0 + given_cost(q["first"], c["first"], q["first_n"], c["first_n"]) if q["last"] == c["last"] else 1.2
    return extra + min(straight, turned, whole)


@lru_cache(maxsize=20_000)
def fields(name: str) -> dict:
    return dict(zip(("kind", "first", "middle", "last", "suffix", "tight", "parts", "acronym", "hint"), parse(name), strict=True))


@lru_cache(maxsize=20_000)
def key_sets(name: str) -> tuple[frozenset[str], frozenset[str]]:
    ask, found = keys(parse(name))
    return frozenset(ask), frozenset(found)


def spellings(mentions: DataFrame) -> DataFrame:
    """(case_id, name, ask, found, full, first_n, last_n, good): the distinct spellings of rows (case_id, name, type).

    All that a spelling is by itself (its parts, its keys, how common its parts are, whether the corpus takes it for a person
    or an organisation) is worked out once per distinct spelling of the corpus, on narrow rows.
    """
    spell = cut(mentions.groupBy("case_id", "name").agg(F.count("*").alias("n"), F.count_if(F.col("type").isin("LOC", "TIME", "EVIDENCE")).alias("n_other"), F.count_if(F.upper("type").isin("PERSON", "PER", "ORG")).alias("n_own")))
    names = spell.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_other").alias("n_other"), F.sum("n_own").alias("n_own"))

    @F.pandas_udf("kind string, first string, key_last string, suffix string, ask array<string>, found array<string>, folded string")
    def parsed(names: pd.Series) -> pd.DataFrame:
        rows = []
        for x in names:
            p = parse(x)
            rows.append((p[0], p[1], p[6][0] if p[0] == "org" else p[3], p[4], *keys(p), re.sub(r"[^a-z0-9]+", " ", fold(x)).strip()))
        return pd.DataFrame(rows, columns=["kind", "first", "key_last", "suffix", "ask", "found", "folded"])

    p = cut(names.withColumn("p", parsed("name")).select("name", "n", "n_other", "n_own", "p.*").where("kind != 'none'"))
    # the type that the corpus mostly gives a spelling decides
    kept = p.groupBy("folded").agg(F.sum("n_other").alias("t_other"), F.sum("n_own").alias("t_own")).where("t_own >= t_other").select("folded")
    own = p.select("name", "folded", "first", "key_last", "n").join(kept, "folded", "left_semi").select("name", "first", "key_last", "n")
    tokens = own.select(F.explode(F.array("first", "key_last")).alias("token"), "n").where("token != ''").groupBy("token").agg(F.sum("n").alias("count"))
    common = own.select("name", "first", "key_last").join(tokens.select(F.col("token").alias("first"), F.col("count").alias("first_n")), "first", "left").join(tokens.select(F.col("token").alias("key_last"), F.col("count").alias("last_n")), "key_last", "left")
    common = common.select("name", F.coalesce("first_n", F.lit(1)).alias("first_n"), F.coalesce("last_n", F.lit(1)).alias("last_n"))
    full = F.col("kind").isin("person", "org")
    rare = F.when(F.col("kind") == "org", F.col("last_n")).otherwise(F.least("first_n", "last_n"))
    plain = F.when((F.col("suffix") == "") & F.col("name").rlike(r"^\p{Lu}[\p{Ll}\p{M}]+(?: \p{Lu}?[\p{Ll}\p{M}'&]*)+$"), 1.0).otherwise(0.0)
    good = F.when(full, 1000.0).otherwise(0.0) + 10 * F.log1p(F.least(rare, F.lit(50))) + 5 * plain
    each = p.select("name", "kind", "suffix", "ask", "found").join(common, "name").select("name", "ask", "found", full.alias("full"), "first_n", "last_n", good.alias("good"))
    return spell.select("case_id", "name", "n").join(each, "name").select("case_id", "name", "ask", "found", "full", "first_n", "last_n", (F.col("good") + F.log1p("n")).alias("good"))


def attach(s: DataFrame) -> DataFrame:
    """(case_id, name, root): every spelling with the canonical form it goes back to.

    Only the spellings themselves, their counts and their rank go through the join on keys; the channel parses them again,
    from a memo.
    """
    q = s.select("case_id", F.explode("ask").alias("key"), F.col("name").alias("q"), F.col("first_n").alias("q_first"), F.col("last_n").alias("q_last"), F.col("good").alias("q_good"))
    c = s.where("full").select("case_id", F.explode("found").alias("key"), F.col("name").alias("c"), F.col("first_n").alias("c_first"), F.col("last_n").alias("c_last"), F.col("good").alias("c_good"))
    above = (F.col("c_good") > F.col("q_good")) | ((F.col("c_good") == F.col("q_good")) & (F.col("c") < F.col("q")))
    pairs = q.join(c, ["case_id", "key"]).where(above)

    @F.pandas_udf("double")
    def channel(key: pd.Series, q: pd.Series, qf: pd.Series, ql: pd.Series, c: pd.Series, cf: pd.Series, cl: pd.Series) -> pd.Series:
        out = []
        for k, a, af, al, b, bf, bl in zip(key, q, qf, ql, c, cf, cl, strict=True):
            # a pair that meets under several keys is judged under the first of them, which needs no shuffle to make pairs distinct
            out.append(cost({**fields(a), "first_n": af, "last_n": al}, {**fields(b), "first_n": bf, "last_n": bl}) if k == min(key_sets(a)[0] & key_sets(b)[1]) else 9.0)
        return pd.Series(out, dtype="float64")

    scored = pairs.withColumn("cost", channel("key", "q", "q_first", "q_last", "c", "c_first", "c_last")).where("cost <= 3")
    best = scored.groupBy("case_id", F.col("q").alias("name")).agg(F.max_by("c", F.struct(F.col("c_good") / 10 - 3 * F.col("cost"), F.col("c"))).alias("parent"))
    links = cut(s.select("case_id", "name").join(best, ["case_id", "name"], "left").withColumn("parent", F.coalesce("parent", "name")))
    while True:  # pointer jumping: the forest's depth halves each time
        up = links.select("case_id", F.col("name").alias("parent"), F.col("parent").alias("next"))
        jumped = cut(links.join(up, ["case_id", "parent"]).select("case_id", "name", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        links = jumped.drop("moved")
        if not moved:
            return links.withColumnRenamed("parent", "root")


def rows_of(entities: DataFrame, global_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions (case_id, id, name, type) of both tables."""
    e = entities.select("case_id", "id", F.trim("entity_name").alias("name"), F.col("entity_name").alias("raw"), F.col("entity_type").alias("type")).where("name != ''")
    g = global_entities.select("case_id", F.col("global_id").alias("id"), F.when(F.size("mentions") > 0, F.col("mentions")).otherwise(F.array(F.regexp_replace("canonical_name", "_", " "))).alias("ms"), F.col("entity_type").alias("type"))
    g = g.select("case_id", "id", F.posexplode("ms").alias("pos", "m"), "type").select("case_id", "id", "pos", F.trim("m").alias("name"), "type").where("name != ''")
    return e, g


def link(entities: DataFrame, global_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables with the ``root`` of their entity: (case_id, id, raw, root), (case_id, id, root)."""
    e, g = rows_of(entities, global_entities)
    mentions = e.select("case_id", "name", "type").unionByName(g.select("case_id", "name", "type"))
    roots = attach(cut(spellings(mentions)))
    own_e = e.join(roots, ["case_id", "name"]).select("case_id", "id", "raw", "root")
    own_g = g.join(roots, ["case_id", "name"]).groupBy("case_id", "id").agg(F.min_by("root", "pos").alias("root"))
    return own_e, own_g


def find(entities: DataFrame, global_entities: DataFrame) -> DataFrame:
    """(src, id_a, id_b): pairs of rows of a case that mean the same person or organisation."""
    e, g = link(entities, global_entities)
    a, b = e.select("case_id", "root", F.col("id").alias("id_a"), F.col("raw").alias("raw_a")), e.select("case_id", "root", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    pe = a.join(b, ["case_id", "root"]).where("id_a < id_b and raw_a != raw_b").select(F.lit("entities").alias("src"), "id_a", "id_b")
    a, b = g.select("case_id", "root", F.col("id").alias("id_a")), g.select("case_id", "root", F.col("id").alias("id_b"))
    pg = a.join(b, ["case_id", "root"]).where("id_a < id_b").select(F.lit("global_entities").alias("src"), "id_a", "id_b")
    return pe.unionByName(pg)


def classes(entities: DataFrame, global_entities: DataFrame) -> DataFrame:
    """(src, row_id, class_id, n_rows): every mention with the smallest id of its entity in its table and case, and the entity's rows."""
    e, g = link(entities, global_entities)
    both = e.select(F.lit("entities").alias("src"), "case_id", "id", "root").unionByName(g.select(F.lit("global_entities").alias("src"), "case_id", "id", "root"))
    size = both.groupBy("src", "case_id", "root").agg(F.min("id").alias("class_id"), F.count("*").alias("n_rows"))
    return both.join(size, ["src", "case_id", "root"]).select("src", F.col("id").alias("row_id"), "class_id", "n_rows")
