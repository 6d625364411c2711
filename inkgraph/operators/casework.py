"""The case pipeline, document texts to a knowledge graph, as one chain of DataFrames.

documents -> segments -> sentences -> entities -> coreference -> unified sentences -> relations -> events -> timeline
-> nodes and edges.  Every stage takes and gives DataFrames keyed by (case_id, doc_name) and can be used alone.  Windows
run over one document only; what is gathered per case goes through mergeable aggregates or joins, so a case with a third
of all rows stays spread out.  The stages are lazy: cut between them with :func:`inkgraph.session.cut` where a stage is read
more than once.

Recognition of entities, pronouns and verbs is by the fixed lists of :mod:`inkgraph.functions.fixed`; statistical models
plug in through :mod:`inkgraph.operators.providers` by giving rows of the same shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import fixed, text
from inkgraph.operators import entities as ent
from inkgraph.operators import events as ev
from inkgraph.operators import graph, relations, segment
from inkgraph.session import cut

DOC = ["case_id", "doc_name"]
MARK = "\u0001"


# --- documents, segments, sentences -----------------------------------------------------------------------------
def documents(narratives: DataFrame, biographies: DataFrame, interviews: DataFrame) -> DataFrame:
    """(case_id, doc_name, doc_type, raw_text): the three kinds of case documents, normalised after their kind; nulls left out."""
    n = narratives.select("case_id", F.concat(F.lit("narrative_"), "id").alias("doc_name"), F.lit("narrative").alias("doc_type"), text.expand(text.narrative(F.col("text"))).alias("raw_text"))
    b = biographies.select("case_id", F.concat(F.lit("biography_"), "id").alias("doc_name"), F.lit("biography").alias("doc_type"), text.biography(F.col("biography")).alias("raw_text"))
    i = interviews.select("case_id", F.concat(F.lit("interview_"), "id").alias("doc_name"), F.lit("interview").alias("doc_type"), text.interview(F.col("interview_text")).alias("raw_text"))
    return n.unionByName(b).unionByName(i).where(F.trim("raw_text") != "")


def segments(docs: DataFrame) -> DataFrame:
    """(case_id, doc_name, doc_type, seg_idx, time, speaker, text) of every document, by the rules of its kind."""
    none = F.lit(None).cast("string")
    cols = [*DOC, "doc_type", "seg_idx", "time", "speaker", "text"]
    kind = lambda k: docs.where(F.col("doc_type") == k)
    parts = F.split(F.regexp_replace("raw_text", fixed.SEGMENT, MARK + "$1"), MARK)
    n = kind("narrative").select(*DOC, "doc_type", F.posexplode(parts).alias("seg_idx", "raw"))
    clock = F.regexp_extract(F.regexp_extract("raw", "(?iu)^" + fixed.SEGMENT[5:], 1), fixed.CLOCK, 0)
    n = n.select(*DOC, "doc_type", "seg_idx", F.when(clock != "", clock).alias("time"), none.alias("speaker"), F.trim("raw").alias("text"))
    b = kind("biography").select(*DOC, "doc_type", F.posexplode(F.split("raw_text", r"\n\s*\n")).alias("seg_idx", "raw"))
    b = b.select(*DOC, "doc_type", "seg_idx", none.alias("time"), none.alias("speaker"), text.squeeze(F.col("raw")).alias("text"))
    i = kind("interview").withColumn("time", segment.header(F.col("raw_text"))["header_time"])
    turns = segment.colon_turns(i.select(F.struct(*DOC, "doc_type", "time").alias("d"), segment.interview_body(F.col("raw_text")).alias("body")), "d", "body")
    i = turns.select("d.*", F.col("turn").cast("int").alias("seg_idx"), "speaker", "text")
    return n.select(cols).unionByName(b.select(cols)).unionByName(i.select(cols)).where("text != ''")


def sentences(segs: DataFrame) -> DataFrame:
    """(segment columns, sent_idx, text, has_time, has_actor, has_env, sentence_id): sentences of segments, numbered per document.

    Narratives merge fragments with the next sentence and flag times, actors and surroundings; biographies flag dates,
    interviews clock times; an actor is never flagged in those.
    """
    base = segs.withColumn("s", segment.sentence_array(F.col("text")))
    said = lambda t: F.struct(t.alias("text"), *[c.alias(k) for k, c in segment.flags(t).items()])
    plain = lambda p: (lambda t: F.struct(t.alias("text"), t.rlike(p).alias("has_time"), F.lit(False).alias("has_actor"), F.lit(False).alias("has_env")))
    s = F.when(F.col("doc_type") == "narrative", segment.merge_flagged(F.transform("s", said))).when(F.col("doc_type") == "biography", F.transform("s", plain("(?i)" + fixed.INLINE_DATE))).otherwise(F.transform("s", plain(fixed.INLINE_CLOCK)))
    out = base.select(*DOC, "doc_type", "seg_idx", "time", "speaker", F.posexplode(s).alias("sent_idx", "x")).select(*DOC, "doc_type", "seg_idx", "time", "speaker", "sent_idx", "x.*")
    w = Window.partitionBy(*DOC).orderBy("seg_idx", "sent_idx")  # the sentences of one document
    return out.withColumn("sentence_id", (F.row_number().over(w) - 1).cast("int"))


# --- entities ---------------------------------------------------------------------------------------------------
def spans(df: DataFrame, keys: list[str], body: str, pattern: str) -> DataFrame:
    """(keys, start, end, text) of the matches of a pattern: characters from 0, end exclusive, all in Catalyst."""
    parts = F.split(F.regexp_replace(F.col(body), pattern, MARK + "$1" + MARK), MARK, -1)
    at = df.where(F.col(body).rlike(pattern)).select(*keys, parts.alias("_p"))
    out = at.select(*keys, "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 2, F.lit(2))).alias("_i"))
    start = F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + F.length(x))
    out = out.select(*keys, start.alias("start"), F.get("_p", F.col("_i")).alias("text"))
    return out.select(*keys, "start", (F.col("start") + F.length("text")).alias("end"), "text")


def label_of(phrase: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of a mention by (pattern, label) rules, the first that fits the whole of it."""
    return reduce(lambda c, r: c.when(phrase.rlike(f"^(?:{r[0]})$"), r[1]), rules[1:], F.when(phrase.rlike(f"^(?:{rules[0][0]})$"), rules[0][1]))


def gazetteer_pattern(rules: list[tuple[str, str]]) -> str:
    """One pattern over all rules, the longest phrase first, on word bounds."""
    return r"\b(" + "|".join(p for p, _ in sorted(rules, key=lambda r: -len(r[0]))) + r")\b"


def recognise(sents: DataFrame, rules: list[tuple[str, str]] = fixed.RULER) -> DataFrame:
    """(case_id, doc_name, seg_idx, sent_idx, sentence_id, start, end, text, label, norm) of listed entities in sentences."""
    keys = [*DOC, "seg_idx", "sent_idx", "sentence_id"]
    out = spans(sents, keys, "text", gazetteer_pattern(rules))
    return out.withColumns({"label": label_of(F.col("text"), rules), "norm": text.ner_norm(F.col("text"))})


# --- coreference ------------------------------------------------------------------------------------------------
def raw_text(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """(case_id, doc_name, raw_text): the text of a document, or its segments joined where it has none."""
    joined = segs.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ").alias("_joined"))
    return docs.join(joined, DOC, "left").select(*DOC, F.coalesce(F.nullif("raw_text", F.lit("")), "_joined", F.lit("")).alias("raw_text"))


def mentions(texts: DataFrame, ents: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(case_id, doc_name, norm, mention, label, source, ord): entities of sentences, clusters of a model, entities of the text, pronouns.

    A pronoun goes to the nearest entity of the text before it (a backward as-of join by window).  ``clusters``: rows
    (case_id, doc_name, ord int, canonical, mention) where a coreference model gives some.
    """
    order = lambda phase, *c: F.struct(F.lit(phase).alias("p"), *[F.col(x).cast("int").alias(f"o{i}") for i, x in enumerate(c)], *[F.lit(0).alias(f"o{i}") for i in range(len(c), 3)])
    cols = [*DOC, "norm", "mention", "label", F.col("doc_name").alias("source"), "ord"]
    a = ents.select(*DOC, "norm", F.col("text").alias("mention"), "label", order(1, "seg_idx", "sent_idx", "start").alias("ord"))
    found = spans(texts, DOC, "raw_text", gazetteer_pattern(fixed.COREF_RULER)).withColumn("label", label_of(F.col("text"), fixed.COREF_RULER)).withColumn("norm", text.coref_norm(F.col("text")))
    pronouns = spans(texts, DOC, "raw_text", r"(?i)\b(" + "|".join(sorted(fixed.COREF_PRONOUNS, key=lambda p: (-len(p), p))) + r")\b")
    both = found.unionByName(pronouns.withColumns({"label": F.lit(None).cast("string"), "norm": F.lit(None).cast("string")}))
    w = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one document
    who = F.last(F.when(F.col("norm").isNotNull(), F.struct("norm", "label")), ignorenulls=True).over(w)
    near = both.withColumn("_who", who)
    b = near.where("norm is not null").select(*DOC, "norm", F.col("text").alias("mention"), "label", order(3, "start").alias("ord"))
    c = near.where("norm is null and _who is not null").select(*DOC, F.col("_who.norm").alias("norm"), F.col("text").alias("mention"), F.col("_who.label").alias("label"), order(4, "start").alias("ord"))
    out = a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols))
    if clusters is not None:
        m = clusters.select(*DOC, text.cluster_norm(F.col("canonical")).alias("norm"), "mention", F.lit("UNKNOWN").alias("label"), order(2, "ord").alias("ord"))
        out = out.unionByName(m.select(cols))
    return out.where("norm != ''")


def document_clusters(ms: DataFrame) -> DataFrame:
    """(case_id, doc_name, global_id, canonical_name, entity_type, mentions, source_docs): the pool of each document after the merges."""
    return ent.merged_pool(ent.pool(ms, DOC), DOC, fixed.UNIQUE_GROUPS)


def case_pool(clusters: DataFrame) -> DataFrame:
    """The pool of each case from the clusters of its documents, in order of document and cluster."""
    m = clusters.select("case_id", F.col("canonical_name").alias("norm"), F.posexplode("mentions").alias("pos", "mention"), F.col("entity_type").alias("label"), F.col("doc_name").alias("source"), "doc_name", "global_id")
    m = m.withColumn("ord", F.struct("doc_name", "global_id", "pos"))
    return ent.pool(m.select("case_id", "norm", "mention", "label", "source", "ord"), ["case_id"])


def pronoun_map(clusters: DataFrame) -> DataFrame:
    """(case_id, doc_name, pronouns): per document what each pronoun stands for; the first cluster that has it wins."""
    c = clusters.withColumn("main", ent.main_mention(F.col("mentions"))).where("main is not null")
    p = c.select(*DOC, "global_id", "main", F.explode("mentions").alias("m")).withColumn("pronoun", F.lower(F.trim("m"))).where(F.col("pronoun").isin(fixed.PRONOUNS))
    first = p.groupBy(*DOC, "pronoun").agg(F.min_by("main", "global_id").alias("main"))
    return first.groupBy(*DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pronoun", "main")))).alias("pronouns"))


def unify(sents: DataFrame, pronouns: DataFrame, expand: bool = True) -> DataFrame:
    """Sentences with pronouns replaced by what they stand for; ``expand``: abbreviations that are left are written out too."""
    out = sents.join(pronouns, DOC, "left")
    edge = r"[^\p{L}\p{N}_]"
    pairs = F.array_sort(F.transform(F.map_entries("pronouns"), lambda e: F.struct((-F.length(e["key"])).alias("size"), F.concat(F.lit(f"(?i)(^|{edge})"), e["key"], F.lit(f"($|{edge})")).alias("pattern"), F.concat(F.lit("$1"), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"), F.lit("$2")).alias("by"))))
    unified = F.aggregate(pairs, F.col("text"), lambda t, x: F.regexp_replace(t, x["pattern"], x["by"]))  # one after the other, the longest first
    out = out.withColumn("unified", F.when(F.col("pronouns").isNull(), F.col("text")).otherwise(unified)).drop("pronouns")
    return out.withColumn("unified", text.expand_tight(F.col("unified"))) if expand else out


# --- relations and events ---------------------------------------------------------------------------------------
def triples(sents: DataFrame, body: str = "unified") -> DataFrame:
    """(case_id, doc_name, sentence_id, subject, predicate, object) by the first listed verb of a sentence.

    The subject is what stands before the verb in its clause, the object what follows up to the clause's end; parsers
    (:mod:`inkgraph.operators.parses`) give the same columns from dependency trees.
    """
    verb = relations.verb_pattern()
    t = sents.select(*DOC, "sentence_id", F.regexp_extract(body, verb, 1).alias("subject"), F.regexp_extract(body, verb, 2).alias("form"), F.regexp_extract(body, verb, 3).alias("object"))
    t = t.where("form != ''").select(*DOC, "sentence_id", text.squeeze(F.col("subject")).alias("subject"), relations.lemma(F.col("form")).alias("predicate"), text.squeeze(F.col("object")).alias("object"))
    return t.where("subject != '' and object != ''")


def good_triples(t: DataFrame, ents: DataFrame, most: int = 15) -> DataFrame:
    """Triples with short arguments that name an entity of their sentence where it has any; "be" needs one in the object."""
    here = ents.groupBy(*DOC, "sentence_id").agg(F.collect_set(F.struct(F.lower("text").alias("text"), "label")).alias("_here"))  # one sentence
    size = lambda c: F.size(F.split(F.col(c), r"\s+"))
    named = lambda c, only: F.exists("_here", lambda e: F.contains(F.lower(F.col(c)), e["text"]) & (e["label"].isin(fixed.OBJECT_LABELS) if only else F.lit(True)))
    t = t.join(here, [*DOC, "sentence_id"], "left").where((size("subject") <= most) & (size("object") <= most))
    t = t.where(F.col("_here").isNull() | named("subject", False) | named("object", False))
    return t.where((F.col("predicate") != "be") | F.coalesce(named("object", True), F.lit(False))).drop("_here")


def refine(base: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Relations with a type: triples by their whole predicate, matched patterns by their own; the rest falls."""
    out = base.withColumn("predicate", F.lower(F.trim("predicate"))).withColumn("relation_type", relations.relation_type(F.col("predicate")))
    if matched is not None:
        out = out.unionByName(matched, allowMissingColumns=True)
    full = (F.trim("subject") != "") & (F.trim("object") != "") & (F.trim("predicate") != "")
    return out.where(F.col("relation_type").isNotNull() & full)


def events(rels: DataFrame, sents: DataFrame, ents: DataFrame) -> DataFrame:
    """(case_id, doc_name, doc_type, event_id, event_no, description, subject, predicate, object, sentence_id, time_raw, participants, locations).

    Relations without a sentence of their document give none.  Participants and locations are sorted sets.
    """
    s = sents.select(*DOC, "doc_type", "sentence_id", F.col("text").alias("_s"), F.col("time").alias("time_raw"))
    e = rels.join(s, [*DOC, "sentence_id"])
    said = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("subject", "predicate", "object")])
    e = e.withColumn("description", F.coalesce(F.nullif("_s", F.lit("")), said)).drop("_s")
    place = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(w)) for w in fixed.PLACE_WORDS], F.col("label") == "LOC")
    here = ents.groupBy(*DOC, "sentence_id").agg(F.array_sort(F.collect_set(F.when(F.col("label").isin(fixed.PARTICIPANT_LABELS), F.col("text")))).alias("participants"), F.collect_set(F.when(place, F.col("text"))).alias("_loc"))
    e = e.join(here, [*DOC, "sentence_id"], "left")
    low = F.lower(F.concat_ws(" ", "description", "subject", "object"))
    none = F.array().cast("array<string>")
    own = F.coalesce("_loc", none)
    words = F.filter(F.array(*map(F.lit, fixed.PLACE_WORDS)), lambda w: F.contains(low, w) & ~F.exists(own, lambda x: F.lower(x) == w))
    e = e.withColumns({"participants": F.coalesce("participants", none), "locations": F.array_sort(F.array_union(own, words))}).drop("_loc")
    e = ev.number_in_doc(e, DOC, ["sentence_id", "predicate", "subject", "object"])
    return e.withColumn("event_id", ev.event_id(F.col("doc_name"), F.col("event_no")))


def timed(evs: DataFrame, days: DataFrame | None = None, incident_date: str = fixed.INCIDENT_DATE) -> DataFrame:
    """The events with ``time_resolved``, their clock time on the day of their case.

    ``days``: (case_id, day) of the incidents; without it every case has ``incident_date``.
    """
    e = evs.withColumn("_day", F.lit(incident_date).cast("date")) if days is None else evs.join(days.withColumnRenamed("day", "_day"), "case_id", "left")
    return e.withColumn("time_resolved", ev.clock_to_iso(F.col("time_raw"), F.col("_day"))).drop("_day")


def before_edges(evs: DataFrame) -> DataFrame:
    """(case_id, source_event, target_event): each timed event BEFORE the next one of its case over all documents."""
    b = ev.before_edges(evs.select("case_id", "time_resolved", F.struct("doc_name", "event_no", "event_id").alias("id")))
    return b.select("case_id", F.col("source_event.event_id").alias("source_event"), F.col("target_event.event_id").alias("target_event"))


# --- graph ------------------------------------------------------------------------------------------------------
def _node(phase: int, df: DataFrame, ident: Column, kind: str, label: Column, shown: Column, order: list[str]) -> DataFrame:
    key = F.struct(F.lit(phase).alias("phase"), F.col("doc_name").alias("doc"), *[F.col(c).cast("int").alias(f"o{i}") for i, c in enumerate(order)], *[F.lit(0).alias(f"o{i}") for i in range(len(order), 3)])
    return df.select("case_id", ident.alias("id"), F.lit(kind).alias("type"), shown.alias("text"), label.cast("string").alias("label"), key.alias("ord"))


def build_graph(ents: DataFrame, evs: DataFrame, rels: DataFrame, before: DataFrame, rules: list[tuple[str, str, str | None]] = fixed.ENDPOINT_RULES, object_rules: list[tuple[str, str, str | None]] = fixed.OBJECT_ENDPOINT_RULES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every case: nodes (case_id, id, type, text, label), edges (case_id, source, target, edge_type, doc_name).

    The first writer of a node gives its text and label: entities, then participants, locations and times of events, then
    the ends of relations, mapped to canonical ids by ``rules``.  Timeline edges need both of their events.
    """
    none = F.lit(None)
    text_ = F.col("text")
    parts = evs.select("case_id", "doc_name", "event_id", "event_no", F.explode("participants").alias("text"))
    places = evs.select("case_id", "doc_name", "event_id", "event_no", F.explode("locations").alias("text"))
    times = evs.where("time_resolved is not null")
    r = rels.where("trim(subject) != '' and trim(object) != ''").withColumns({"_s": text.graph_norm(F.col("subject")), "_o": text.graph_norm(F.col("object"))})
    r = r.withColumns({"source": graph.canonical_end(F.col("_s"), rules), "target": graph.canonical_end(F.col("_o"), [*rules, *object_rules])})
    end = lambda c, shown, phase: [_node(phase, r.where(F.col(c).startswith(p)), F.col(c), k, none, F.trim(shown), ["sentence_id"]) for p, k in (("ENT_", "Entity"), ("LOC_", "Location"))]
    nodes = [
        _node(1, ents.where("text != ''"), text.entity_id(F.coalesce(F.nullif("norm", F.lit("")), "text")), "Entity", F.col("label"), text_, ["seg_idx", "sent_idx", "start"]),
        _node(2, parts, text.entity_id(text_), "Entity", none, text_, ["event_no"]),
        _node(2, evs, F.col("event_id"), "Event", none, F.col("description"), ["event_no"]),
        _node(2, places, text.entity_id(text_, "LOC_"), "Location", none, text_, ["event_no"]),
        _node(2, times, text.time_id(F.col("time_resolved")), "Time", none, F.col("time_resolved"), ["event_no"]),
        *end("source", F.col("subject"), 3), *end("target", F.col("object"), 4),
    ]
    out = reduce(DataFrame.unionByName, nodes)
    out = graph.first_by(out, ["case_id", "id"], "ord", ["type", "text", "label"])
    known = evs.select("case_id", F.col("event_id").alias("_e"))
    b = before.join(known, (before.case_id == known.case_id) & (before.source_event == known._e), "left_semi").join(known, (before.case_id == known.case_id) & (before.target_event == known._e), "left_semi")
    edge = lambda df, s, t, k, doc=none: df.select("case_id", s.alias("source"), t.alias("target"), F.lit(k).alias("edge_type") if isinstance(k, str) else k.alias("edge_type"), doc.cast("string").alias("doc_name"))
    typed = r.withColumn("edge_type", relations.edge_or_owns(F.col("relation_type"), F.col("_o"))).where("edge_type is not null")
    edges = [
        edge(parts, text.entity_id(text_), F.col("event_id"), "PARTICIPATED_IN"), edge(places, F.col("event_id"), text.entity_id(text_, "LOC_"), "LOCATED_AT"), edge(times, F.col("event_id"), text.time_id(F.col("time_resolved")), "HAS_TIME"),
        edge(b, F.col("source_event"), F.col("target_event"), "BEFORE"), edge(b, F.col("target_event"), F.col("source_event"), "AFTER"), edge(typed, F.col("source"), F.col("target"), F.col("edge_type"), F.col("doc_name")),
    ]
    return out, reduce(DataFrame.unionByName, edges)


def entity_ranks(nodes: DataFrame, edges: DataFrame, iterations: int | None = None) -> DataFrame:
    """(case_id, id, score): PageRank of the entity nodes of each case over the edges between entities."""
    own = nodes.where("type = 'Entity'").select("case_id", "id")
    return graph.pagerank_by(edges.where("source like 'ENT\\_%' and target like 'ENT\\_%'"), own, "case_id", iterations)


def run(docs: DataFrame, days: DataFrame | None = None, keep=cut) -> dict[str, DataFrame]:
    """All stages by name.  ``keep`` is applied to the stages that are read more than once; without a cut the plans multiply."""
    out: dict[str, DataFrame] = {"documents": docs}
    out["segments"] = segments(docs)
    out["sentences"] = keep(sentences(out["segments"]))
    out["entities"] = keep(recognise(out["sentences"]))
    out["clusters"] = keep(document_clusters(mentions(docs, out["entities"])))
    out["pool"] = case_pool(out["clusters"])
    out["unified"] = unify(out["sentences"], pronoun_map(out["clusters"]))
    out["relations"] = keep(refine(good_triples(triples(out["unified"]), out["entities"])))
    out["events"] = keep(timed(events(out["relations"], out["sentences"], out["entities"]), days))
    out["timeline"] = before_edges(out["events"])
    out["nodes"], out["edges"] = build_graph(out["entities"], out["events"], out["relations"], out["timeline"])
    return out


def export(stages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a unified case export: documents, global entities, local entities, relations and events."""
    kind = stages["documents"].select(*DOC, F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"))
    return {
        "documents": kind, "global_entities": stages["pool"],
        "nodes_local_entities": stages["entities"].join(kind, DOC).select(*DOC, "doc_type", "text", "label", "norm", F.col("seg_idx").alias("segment_index"), F.col("sent_idx").alias("sentence_index")),
        "edges_relations": stages["relations"].join(kind, DOC).select(*DOC, "doc_type", "subject", "predicate", "object", "sentence_id"),
        "edges_events": stages["events"].select(*DOC, "doc_type", "description", "subject", "predicate", "object", "sentence_id", "time_raw", "time_resolved"),
    }


def verify(stages: dict[str, DataFrame], min_relations: int = 5) -> DataFrame:
    """Per case the counts and checks of its outputs: entities, relations, events with subject and predicate, graph, timeline, issues."""
    n = lambda df, name, c=None: df.groupBy("case_id").agg((F.count("*") if c is None else F.count_if(c)).alias(name))
    both = (F.col("subject") != "") & (F.col("predicate") != "")
    cases = stages["documents"].select("case_id").distinct()
    parts = [
        n(stages["entities"], "n_entities"), n(stages["relations"], "n_relations"), n(stages["events"], "n_events"), n(stages["events"], "n_complete_events", both), n(stages["timeline"], "n_before"), n(stages["nodes"], "n_nodes"), n(stages["edges"], "n_edges"),
        n(stages["entities"], "bad_entities", F.col("text").isNull()), n(stages["relations"], "bad_relations", (F.coalesce("subject", F.lit("")) == "") | (F.coalesce("object", F.lit("")) == "")), n(stages["events"], "bad_events", F.col("event_id").isNull()),
    ]
    out = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, cases).fillna(0)
    ok = (F.col("n_entities") > 0) & (F.col("n_relations") >= min_relations) & (F.col("n_events") > 0) & (F.col("n_complete_events") > 0) & (F.col("n_nodes") > 0) & (F.col("n_edges") > 0)
    return out.withColumns({"timeline_has_before_after": F.col("n_before") > 0, "passed": ok & (F.col("bad_entities") + F.col("bad_relations") + F.col("bad_events") == 0)})
