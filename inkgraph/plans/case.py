"""Queries of the case pipeline with the SQL that says the same, written with constants of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.functions import text
from inkgraph.operators import casework, graph, parses, providers, segment
from inkgraph.plans.core import query, sql_expand, sql_narrative, sql_squeeze
from inkgraph.sources import models
from inkgraph.sources.tables import table

# --- SQL, stage by stage ----------------------------------------------------------------------------------------
_CLOCK = r"(?i)\b\d{1,2}[:.]\d{2}\s*(?:a\.?\s*m\.?|p\.?\s*m\.?)"
_SEGMENT = r"(?i)(At \d{1,2}:\d{2} (?:a\.m\.|p\.m\.)|Reporting Officer \w+|Reporting Investigator \w+|Inspector \w+|Deputy \w+)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_NO_END = r"Dr|Mr|Mrs|Ms|St|No|Jr|Sr|Lt|Sgt|Insp|Ofc|Inc|Ltd|Co|vs|etc|approx|a\.m|p\.m|e\.g|i\.e"
_D = "case_id, doc_name"

_DOCS = rf"""docs AS (SELECT * FROM (
    SELECT case_id, 'narrative_' || id AS doc_name, 'narrative' AS doc_type, {sql_expand(sql_narrative('text'))} AS raw_text FROM narratives
    UNION ALL SELECT case_id, 'biography_' || id, 'biography', trim(regexp_replace(regexp_replace(replace(biography, chr(13)||chr(10), chr(10)), '\n{{3,}}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g')) FROM victim_biographies
    UNION ALL SELECT case_id, 'interview_' || id, 'interview', trim(regexp_replace(regexp_replace(replace(interview_text, chr(13)||chr(10), chr(10)), '\n{{2,}}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g')) FROM suspect_interviews) WHERE trim(raw_text, ' ') <> '')"""
_BODY = r"trim(regexp_replace(raw_text, '^[^\n]*(\n|$)([ \t]*[^ \t\n][^\n]*(\n|$))?', ''), ' ')"
_SEGS = rf"""n0 AS (SELECT {_D}, doc_type, string_split(regexp_replace(raw_text, '{_SEGMENT}', chr(1) || '\1', 'g'), chr(1)) AS p FROM docs WHERE doc_type = 'narrative'),
    n1 AS (SELECT {_D}, doc_type, i AS seg_idx, p[i + 1] AS raw FROM (SELECT *, unnest(range(0, len(p))) AS i FROM n0)),
    b0 AS (SELECT {_D}, doc_type, regexp_split_to_array(raw_text, '\n\s*\n') AS p FROM docs WHERE doc_type = 'biography'),
    i0 AS (SELECT {_D}, doc_type, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[2] AS time, string_split({_BODY}, chr(10)) AS p FROM docs WHERE doc_type = 'interview'),
    i1 AS (SELECT {_D}, doc_type, time, i, trim(p[i + 1], ' ') AS line FROM (SELECT *, unnest(range(0, len(p))) AS i FROM i0)),
    i2 AS (SELECT *, regexp_matches(line, '^[^:]+:') AS opens FROM i1 WHERE line <> ''), i3 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {_D} ORDER BY i) AS turn FROM i2),
    i4 AS (SELECT {_D}, doc_type, turn AS seg_idx, any_value(time) AS time, coalesce(max(CASE WHEN opens THEN trim(regexp_extract(line, '^([^:]+):', 1), ' ') END), 'NARRATOR') AS speaker,
      trim(string_agg(CASE WHEN opens THEN trim(regexp_replace(line, '^[^:]+:', ''), ' ') ELSE line END, ' ' ORDER BY i), ' ') AS text FROM i3 GROUP BY {_D}, doc_type, turn),
    segs AS (SELECT * FROM (SELECT {_D}, doc_type, seg_idx::INT AS seg_idx, nullif(regexp_extract(regexp_extract(raw, '(?i)^{_SEGMENT[4:]}', 1), '{_CLOCK}', 0), '') AS time, NULL AS speaker, trim(raw, ' ') AS text FROM n1
      UNION ALL SELECT {_D}, doc_type, i::INT, NULL, NULL, {sql_squeeze('p[i + 1]')} FROM (SELECT *, unnest(range(0, len(p))) AS i FROM b0) UNION ALL SELECT {_D}, doc_type, seg_idx::INT, time, speaker, text FROM i4) WHERE text <> '')"""
_GUARDED = rf"string_split(regexp_replace(regexp_replace({sql_squeeze('text')}, '\b({_NO_END})\.', '\1' || chr(2), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SENTS = rf"""s0 AS (SELECT {_D}, doc_type, seg_idx, time, speaker, list_filter(list_transform({_GUARDED}, lambda x: replace(x, chr(2), '.')), lambda x: x <> '') AS p FROM segs),
    s1 AS (SELECT {_D}, doc_type, seg_idx, time, speaker, i, p[i + 1] AS text FROM (SELECT *, unnest(range(0, len(p))) AS i FROM s0)),
    s2 AS (SELECT *, doc_type = 'narrative' AND len(string_split(text, ' ')) < 3 AND NOT regexp_matches(text, '[.!?]$') AS short,
      CASE doc_type WHEN 'narrative' THEN regexp_matches(text, '{_CLOCK}') WHEN 'biography' THEN regexp_matches(text, '(?i)\b(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b') ELSE regexp_matches(text, '(?i)\b\d{{1,2}}:\d{{2}}\s*(?:a\.m\.|p\.m\.|am|pm)') END AS ht,
      doc_type = 'narrative' AND regexp_matches(text, '(?i)\b(?:Reporting Officer|Reporting Investigator|Officer|Detective|Inspector|Deputy)s?\b') AS ha, doc_type = 'narrative' AND regexp_matches(text, '(?i)\b(?:Weather|Temperature|Humidity)\b') AS he FROM s1),
    s3 AS (SELECT *, lead(text) OVER w AS nt, lead(ht) OVER w AS nht, lead(ha) OVER w AS nha, lead(he) OVER w AS nhe, i - 1 - coalesce(max(CASE WHEN NOT short THEN i END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run FROM s2 WINDOW w AS (PARTITION BY {_D}, seg_idx ORDER BY i)),
    s4 AS (SELECT {_D}, doc_type, seg_idx, time, speaker, i, short AND nt IS NOT NULL AS two, text, nt, ht, ha, he, nht, nha, nhe FROM s3 WHERE run % 2 = 0),
    sents AS (SELECT {_D}, doc_type, seg_idx, time, speaker, (row_number() OVER (PARTITION BY {_D}, seg_idx ORDER BY i) - 1)::INT AS sent_idx, CASE WHEN two THEN text || ' ' || nt ELSE text END AS text, CASE WHEN two THEN ht OR nht ELSE ht END AS has_time,
      CASE WHEN two THEN ha OR nha ELSE ha END AS has_actor, CASE WHEN two THEN he OR nhe ELSE he END AS has_env, (row_number() OVER (PARTITION BY {_D} ORDER BY seg_idx, i) - 1)::INT AS sentence_id FROM s4)"""

_A = [("Reporting Investigator", "ROLE"), (r"(?i:deceased)\s+(?i:body)", "EVIDENCE"), (r"(?i:human)\s+(?i:remains)", "EVIDENCE"), ("Coroner''s Inspector", "ROLE"), ("Reporting Officer", "ROLE"), ("Crime Scene Unit", "ORG"), (r"(?i:unit)\s+\d+", "ORG"), ("Animal Control", "ORG"), ("residence", "LOC"), ("briefcase", "EVIDENCE"), ("Dispatch", "ORG"), ("handbag", "EVIDENCE"), ("Deputy", "ROLE"), ("victim", "PERSON"), ("body", "EVIDENCE"), ("dog", "EVIDENCE")]
_B = [("Reporting Investigator", "ROLE"), ("Coroner''s Inspector", "ROLE"), ("Reporting Officer", "ROLE"), ("Crime Scene Unit", "ORG"), ("Residence", "LOC"), ("Witness", "PERSON"), ("Deputy", "ROLE"), ("Victim", "PERSON"), ("Scene", "LOC"), ("Body", "EVIDENCE"), ("Dog", "EVIDENCE")]


def _spans(name: str, src: str, keys: str, body: str, pattern: str) -> str:
    return f"""{name}0 AS (SELECT {keys}, string_split(regexp_replace({body}, '{pattern}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM {src}),
    {name}1 AS (SELECT *, unnest(range(2, len(p), 2)) AS k FROM {name}0 WHERE len(p) > 1), {name} AS (SELECT {keys}, list_sum(list_transform(p[1:k - 1], lambda x: length(x)))::INT AS start_char, p[k] AS text FROM {name}1)"""


def _label(c: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({c}, '{p}') THEN '{label}'" for p, label in rules) + " END"


_ENTS = _spans("ea", "sents", f"{_D}, seg_idx, sent_idx, sentence_id", "text", r"\b(" + "|".join(p for p, _ in _A) + r")\b") + f", ents AS (SELECT *, {_label('text', _A)} AS label, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS norm FROM ea)"
_PRON = ["theirs", "their", "hers", "them", "they", "her", "him", "his", "she", "he"]
_COREF_NORM = "replace(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' ', '_')"
_MENT = (_spans("eb", "docs", _D, "raw_text", r"\b(" + "|".join(p for p, _ in _B) + r")\b") + ", " + _spans("ep", "docs", _D, "raw_text", r"(?i)\b(" + "|".join(_PRON) + r")\b") + f""",
    nr0 AS (SELECT {_D}, start_char, text, {_COREF_NORM} AS norm, {_label('text', _B)} AS label FROM eb UNION ALL SELECT {_D}, start_char, text, NULL, NULL FROM ep),
    nr AS (SELECT *, last_value(CASE WHEN norm IS NOT NULL THEN {{'n': norm, 'l': label}} END IGNORE NULLS) OVER (PARTITION BY {_D} ORDER BY start_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS who FROM nr0),
    ment AS (SELECT * FROM (SELECT {_D}, norm, text AS mention, label, [1, seg_idx, sent_idx, start_char] AS ord FROM ents UNION ALL SELECT {_D}, norm, text, label, [3, start_char, 0, 0] FROM nr WHERE norm IS NOT NULL
      UNION ALL SELECT {_D}, who.n, text, who.l, [4, start_char, 0, 0] FROM nr WHERE norm IS NULL AND who IS NOT NULL) WHERE norm <> ''),
    mb AS (SELECT {_D}, norm, mention, min(ord) AS o, arg_min(label, ord) AS label FROM ment GROUP BY ALL),
    pool AS (SELECT {_D}, norm, min(o) AS o, arg_min(label, o) AS entity_type, list(mention ORDER BY o) AS mentions FROM mb GROUP BY {_D}, norm),
    p0 AS (SELECT *, row_number() OVER (PARTITION BY {_D} ORDER BY o) AS gid, row_number() OVER (PARTITION BY {_D} ORDER BY o) AS into_id FROM pool)""")  # fmt: skip
for _i, _g in enumerate(["victim|deceased|body", "dog", "body", "scene", "residence"]):
    _MENT += f""", h{_i} AS (SELECT {_D}, gid, min(gid) OVER (PARTITION BY {_D}) AS f FROM p{_i} WHERE into_id = gid AND regexp_matches(norm, '{_g}')), p{_i + 1} AS (SELECT p.* EXCLUDE (into_id), coalesce(h.f, p.into_id) AS into_id FROM p{_i} p LEFT JOIN h{_i} h ON h.case_id = p.case_id AND h.doc_name = p.doc_name AND h.gid = p.into_id)"""
_CLUST = _MENT + f", clust AS (SELECT {_D}, into_id AS global_id, max(CASE WHEN gid = into_id THEN norm END) AS canonical_name, max(CASE WHEN gid = into_id THEN entity_type END) AS entity_type, flatten(list(mentions ORDER BY gid)) AS mentions FROM p5 GROUP BY {_D}, into_id)"

_ALL_PRON = ["theirs", "their", "hers", "them", "they", "her", "him", "his", "its", "she", "he", "it"]
_IN = ", ".join(f"'{p}'" for p in _ALL_PRON)
_UNIF = f"""mm0 AS (SELECT {_D}, global_id, i, mentions[i + 1] AS m FROM (SELECT *, unnest(range(0, len(mentions))) AS i FROM clust)),
    mn AS (SELECT {_D}, global_id, arg_max(m, [length(m), -i]) AS main FROM mm0 WHERE lower(trim(m, ' ')) NOT IN ({_IN}) GROUP BY ALL),
    pm AS (SELECT a.case_id, a.doc_name, lower(trim(a.m, ' ')) AS pron, arg_min(b.main, a.global_id) AS main FROM mm0 a JOIN mn b USING (case_id, doc_name, global_id) WHERE lower(trim(a.m, ' ')) IN ({_IN}) GROUP BY ALL),
    pv AS (SELECT {_D}, {', '.join(f"max(CASE WHEN pron = '{p}' THEN main END) AS p_{p}" for p in _ALL_PRON)} FROM pm GROUP BY ALL),
    u0 AS (SELECT s.*, s.text AS u, {', '.join(f'pv.p_{p}' for p in _ALL_PRON)} FROM sents s LEFT JOIN pv USING (case_id, doc_name))"""
for _i, _p in enumerate(_ALL_PRON):
    _UNIF += rf", u{_i + 1} AS (SELECT * REPLACE (CASE WHEN p_{_p} IS NOT NULL THEN regexp_replace(u, '(?i)(^|[^\p{{L}}\p{{N}}_]){_p}($|[^\p{{L}}\p{{N}}_])', '\1' || p_{_p} || '\2', 'g') ELSE u END AS u) FROM u{_i})"
_TIGHT = "u"
for _p, _full in (("R/O", "Reporting Officer"), ("R/Os", "Reporting Officers"), ("R/I", "Reporting Investigator"), ("R/Is", "Reporting Investigators"), ("CSU", "Crime Scene Unit"), ("ETA", "Estimated Time of Arrival")):
    _TIGHT = rf"regexp_replace({_TIGHT}, '\b{_p}\b', '{_full}', 'g')"
_UNIF += f", uni AS (SELECT * EXCLUDE (u), {_TIGHT} AS unified FROM u12)"

#: verb: type of relation, other forms than the regular ones
_VERBS = """arrive ARRIVED_AT;secure SECURED;observe OBSERVED;remove REMOVED;pronounce PRONOUNCED;respond RESPONDED;identify IDENTIFIED;meet MET met;direct DIRECTED;interview INTERVIEWED;examine EXAMINED;report CLAIMED;say CLAIMED said;indicate CLAIMED;call DISPATCHED;dispatch DISPATCHED;find DISCOVERED found;see OBSERVED saw seen;hear HEARD heard;tell STATED told;ask ASKED;state STATED;believe BELIEVED;know KNEW knew known;witness WITNESSED;locate LOCATED;take TOOK took taken;give GAVE gave given;receive RECEIVED;provide PROVIDED;request REQUESTED;confirm CONFIRMED;determine DETERMINED;investigate INVESTIGATED;document DOCUMENTED;collect COLLECTED;seize SEIZED;transport TRANSPORTED;process PROCESSED;review REVIEWED;note NOTED;discover DISCOVERED;describe DESCRIBED;mention MENTIONED;claim CLAIMED;bear HAS_PARENT bore born borne;marry MARRIED_TO;work WORKS_AT;teach WORKS_AT taught;graduate STUDIES_AT;own OWNS_BUSINESS;live LIVES_AT;socialize FREQUENTS;notify NOTIFIED_ABOUT;contact CONTACTED_ABOUT"""


def _verb_forms() -> dict[str, tuple[str, str | None]]:
    out: dict[str, tuple[str, str | None]] = {f: ("be", None) for f in "be is was are were been am".split()}
    out |= {"sister": ("sister", "HAS_SIBLING"), "boyfriend": ("boyfriend", "PARTNER_OF")}
    for line in _VERBS.split(";"):
        v, kind, *odd = line.split()
        cut_e = v.rstrip("e") if v != "see" else v
        soft = v[-1] == "y" and v[-2] in "fr"
        out |= {f: (v, kind) for f in (v, v[:-1] + "ies" if soft else v + "es" if v[-1] in "sx" or v[-2:] in ("ch", "sh") else v + "s", *(odd or [v[:-1] + "ied" if soft else cut_e + "ed"]), cut_e + "ing")}
    return out


_FORMS = _verb_forms()
_IN_CLAUSE = '[^,;:.!?“”"]'
_VERB = rf'(?is)(?:^|[,;:.!?“”"])\s*({_IN_CLAUSE}*?\s)(' + "|".join(sorted(_FORMS, key=lambda f: (-len(f), f))) + rf")(\s{_IN_CLAUSE}*)"
_VALUES = ", ".join(f"('{f}', '{v}', {'NULL' if k is None else chr(39) + k + chr(39)})" for f, (v, k) in _FORMS.items())
_RELS = f"""vf AS (SELECT * FROM (VALUES {_VALUES}) t(form, lemma, kind)), t0 AS (SELECT {_D}, sentence_id, regexp_extract(unified, '{_VERB}', ['s', 'f', 'o']) AS g FROM uni),
    t1 AS (SELECT {_D}, sentence_id, {sql_squeeze('g.s')} AS subject, lemma AS predicate, kind AS relation_type, {sql_squeeze('g.o')} AS object FROM t0 JOIN vf ON lower(g.f) = form WHERE g.f <> ''),
    good AS (SELECT t.* FROM t1 t WHERE subject <> '' AND object <> '' AND len(string_split(subject, ' ')) <= 15 AND len(string_split(object, ' ')) <= 15
      AND (NOT EXISTS (SELECT 1 FROM ents e WHERE e.case_id = t.case_id AND e.doc_name = t.doc_name AND e.sentence_id = t.sentence_id) OR EXISTS (SELECT 1 FROM ents e WHERE e.case_id = t.case_id AND e.doc_name = t.doc_name AND e.sentence_id = t.sentence_id AND (contains(lower(t.subject), lower(e.text)) OR contains(lower(t.object), lower(e.text)))))
      AND (predicate <> 'be' OR EXISTS (SELECT 1 FROM ents e WHERE e.case_id = t.case_id AND e.doc_name = t.doc_name AND e.sentence_id = t.sentence_id AND e.label IN ('PERSON', 'ORG', 'EVIDENCE') AND contains(lower(t.object), lower(e.text))))),
    rels AS (SELECT * FROM good WHERE relation_type IS NOT NULL)"""
_PLACES = ["residence", "house", "home", "basement", "stairs", "staircase", "bedroom", "living room", "kitchen", "bathroom", "porch", "gallery", "diner", "big bad breakfast", "the lucky café", "c''est belle"]
_PLACE_LIST = ", ".join(f"'{w}'" for w in _PLACES)
_EVTS = rf"""en AS (SELECT {_D}, sentence_id, list_sort(list(DISTINCT text) FILTER (label IN ('PERSON', 'ROLE', 'ORG', 'EVIDENCE'))) AS participants, list(DISTINCT text) FILTER (label = 'LOC' OR {' OR '.join(f"contains(lower(text), '{w}')" for w in _PLACES)}) AS loc FROM ents GROUP BY ALL),
    ev0 AS (SELECT r.*, s.doc_type, s.text AS description, s.time AS time_raw, coalesce(en.participants, []) AS participants, coalesce(en.loc, []) AS loc, lower(concat_ws(' ', s.text, r.subject, r.object)) AS low FROM rels r JOIN sents s USING (case_id, doc_name, sentence_id) LEFT JOIN en USING (case_id, doc_name, sentence_id)),
    ev1 AS (SELECT * EXCLUDE (loc, low), list_sort(list_distinct(list_concat(loc, list_filter([{_PLACE_LIST}], lambda w: contains(low, w) AND NOT list_contains(list_transform(loc, lambda x: lower(x)), w))))) AS locations, row_number() OVER (PARTITION BY {_D} ORDER BY sentence_id, predicate, subject, object) AS event_no FROM ev0),
    ev2 AS (SELECT *, doc_name || '_EV' || event_no AS event_id, regexp_extract(time_raw, '(?i)\b(\d{{1,2}})[:.](\d{{2}})\s*([ap])\.?\s*m', ['h', 'm', 'p']) AS c FROM ev1),
    evts AS (SELECT * EXCLUDE (c), CASE WHEN TRY_CAST(c.h AS INT) BETWEEN 1 AND 12 AND TRY_CAST(c.m AS INT) BETWEEN 0 AND 59 THEN printf('2022-10-16T%02d:%02d:00', TRY_CAST(c.h AS INT) % 12 + CASE WHEN lower(c.p) = 'p' THEN 12 ELSE 0 END, TRY_CAST(c.m AS INT)) END AS time_resolved FROM ev2),
    bef AS (SELECT case_id, event_id AS source_event, lead(event_id) OVER (PARTITION BY case_id ORDER BY time_resolved, doc_name, event_no) AS target_event FROM evts WHERE time_resolved IS NOT NULL)"""


def _gid(c: str, prefix: str = "ENT_") -> str:
    return f"'{prefix}' || replace(lower({sql_squeeze(c)}), ' ', '_')"


def _end(c: str, more: str = "") -> str:
    own = f"'ENT_' || replace({c}, ' ', '_')"
    homes = " ".join(f"WHEN 'the {w}' THEN 'LOC_{i}'" for w, i in [("scene", "home"), ("residence", "home"), ("house", "home"), *[(x, x) for x in ("basement", "bedroom", "gallery", "kitchen", "porch", "stairs")]])
    return f"coalesce(CASE {c} {homes} END, CASE WHEN contains({c}, 'reporting officer') OR contains({c}, 'reporting investigator') THEN {own} WHEN contains({c}, 'dog') OR contains({c}, 'thoreau') THEN 'ENT_thoreau' {more} ELSE {own} END)"


_MORE = "WHEN contains({0}, 'body') THEN 'ENT_body' WHEN contains({0}, 'handbag') THEN 'ENT_handbag' WHEN contains({0}, 'briefcase') THEN 'ENT_briefcase'".format("o")
_GRAPH = f"""re0 AS (SELECT *, lower({sql_squeeze('subject')}) AS s, lower({sql_squeeze('object')}) AS o FROM rels), re AS (SELECT *, {_end('s')} AS source, {_end('o', _MORE)} AS target FROM re0),
    pa AS (SELECT case_id, doc_name, event_no, event_id, unnest(participants) AS text FROM evts), pl AS (SELECT case_id, doc_name, event_no, event_id, unnest(locations) AS text FROM evts),
    kind AS (SELECT 'ENT_' AS prefix, 'Entity' AS type UNION ALL SELECT 'LOC_', 'Location'),
    nd AS (SELECT case_id, 'ENT_' || replace(lower({sql_squeeze("coalesce(nullif(norm, ''), text)")}), ' ', '_') AS id, 'Entity' AS type, text, label, {{'p': 1, 'd': doc_name, 'a': seg_idx, 'b': sent_idx, 'c': start_char}} AS ord FROM ents WHERE text <> ''
      UNION ALL SELECT case_id, {_gid('text')}, 'Entity', text, NULL, {{'p': 2, 'd': doc_name, 'a': event_no::INT, 'b': 0, 'c': 0}} FROM pa UNION ALL SELECT case_id, event_id, 'Event', description, NULL, {{'p': 2, 'd': doc_name, 'a': event_no::INT, 'b': 0, 'c': 0}} FROM evts
      UNION ALL SELECT case_id, {_gid('text', 'LOC_')}, 'Location', text, NULL, {{'p': 2, 'd': doc_name, 'a': event_no::INT, 'b': 0, 'c': 0}} FROM pl
      UNION ALL SELECT case_id, 'TIME_' || regexp_replace(time_resolved, '[:T-]', '', 'g'), 'Time', time_resolved, NULL, {{'p': 2, 'd': doc_name, 'a': event_no::INT, 'b': 0, 'c': 0}} FROM evts WHERE time_resolved IS NOT NULL
      UNION ALL SELECT case_id, source, type, trim(subject, ' '), NULL, {{'p': 3, 'd': doc_name, 'a': sentence_id, 'b': 0, 'c': 0}} FROM re JOIN kind ON starts_with(source, prefix) UNION ALL SELECT case_id, target, type, trim(object, ' '), NULL, {{'p': 4, 'd': doc_name, 'a': sentence_id, 'b': 0, 'c': 0}} FROM re JOIN kind ON starts_with(target, prefix)),
    nodes AS (SELECT case_id, id, arg_min({{'t': type, 'x': text, 'l': label}}, ord) AS f FROM nd GROUP BY case_id, id),
    edges AS (SELECT case_id, {_gid('text')} AS source, event_id AS target, 'PARTICIPATED_IN' AS edge_type, NULL AS doc_name FROM pa UNION ALL SELECT case_id, event_id, {_gid('text', 'LOC_')}, 'LOCATED_AT', NULL FROM pl UNION ALL SELECT case_id, event_id, 'TIME_' || regexp_replace(time_resolved, '[:T-]', '', 'g'), 'HAS_TIME', NULL FROM evts WHERE time_resolved IS NOT NULL
      UNION ALL SELECT case_id, source_event, target_event, 'BEFORE', NULL FROM bef WHERE target_event IS NOT NULL UNION ALL SELECT case_id, target_event, source_event, 'AFTER', NULL FROM bef WHERE target_event IS NOT NULL
      UNION ALL SELECT case_id, source, target, CASE WHEN relation_type = 'REMOVED' THEN 'OBSERVED' ELSE relation_type END, doc_name FROM re)"""  # fmt: skip

_TO_SENTS = f"WITH {_DOCS}, {_SEGS}, {_SENTS}"
_TO_ENTS = f"{_TO_SENTS}, {_ENTS}"
_TO_CLUST = f"{_TO_ENTS}, {_CLUST}"
_TO_UNIF = f"{_TO_CLUST}, {_UNIF}"
_TO_RELS = f"{_TO_UNIF}, {_RELS}"
_TO_EVTS = f"{_TO_RELS}, {_EVTS}"
_TO_GRAPH = f"{_TO_EVTS}, {_GRAPH}"


# --- queries ----------------------------------------------------------------------------------------------------
def _docs(spark, sf):
    return casework.documents(table(spark, sf, "narratives"), table(spark, sf, "victim_biographies"), table(spark, sf, "suspect_interviews"))


def _stages(spark, sf):
    return casework.run(_docs(spark, sf))


@query("c4_interview_body", f"WITH {_DOCS} SELECT doc_name, {_BODY} AS body FROM docs WHERE doc_type = 'interview'")
def c4(spark, sf):
    return _docs(spark, sf).where("doc_type = 'interview'").select("doc_name", segment.interview_body(F.col("raw_text")).alias("body"))


@query("c9_case_sentences", f"{_TO_SENTS} SELECT doc_name, seg_idx, sent_idx, sentence_id, time, speaker, text, has_time, has_actor, has_env FROM sents")
def c9(spark, sf):
    return casework.sentences(casework.segments(_docs(spark, sf))).select("doc_name", "seg_idx", "sent_idx", "sentence_id", "time", "speaker", "text", "has_time", "has_actor", "has_env")


@query("c10_processed_documents", f"{_TO_SENTS} SELECT doc_name, doc_type, count(DISTINCT seg_idx) AS n_segments, count(*) AS n_sentences, count(*) FILTER (has_time) AS n_timed FROM sents GROUP BY ALL")
def c10(spark, sf):
    s = casework.sentences(casework.segments(_docs(spark, sf)))
    return s.groupBy("doc_name", "doc_type").agg(F.count_distinct("seg_idx").alias("n_segments"), F.count("*").alias("n_sentences"), F.count_if("has_time").alias("n_timed"))


@query("e3_case_entities", f"{_TO_ENTS} SELECT doc_name, seg_idx, sent_idx, sentence_id, start_char, start_char + length(text) AS end_char, text, label, norm FROM ents")
def e3(spark, sf):
    e = casework.recognise(casework.sentences(casework.segments(_docs(spark, sf))))
    return e.select("doc_name", "seg_idx", "sent_idx", "sentence_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "text", "label", "norm")


@query("e2_text_entities", "WITH " + _DOCS + ", " + _spans("eb", "docs", _D, "raw_text", r"\b(" + "|".join(p for p, _ in _B) + r")\b") + f" SELECT doc_name, start_char, text, {_label('text', _B)} AS label FROM eb")
def e2(spark, sf):
    from inkgraph.functions import fixed

    e = casework.spans(_docs(spark, sf), casework.DOC, "raw_text", casework.gazetteer_pattern(fixed.COREF_RULER))
    return e.select("doc_name", F.col("start").alias("start_char"), "text", casework.label_of(F.col("text"), fixed.COREF_RULER).alias("label"))


def _clusters(spark, sf):
    docs = _docs(spark, sf)
    return casework.document_clusters(casework.mentions(docs, casework.recognise(casework.sentences(casework.segments(docs)))))


@query("f6_document_clusters", f"{_TO_CLUST} SELECT doc_name, global_id, canonical_name, entity_type, array_to_string(mentions, '|') AS mentions FROM clust")
def f6(spark, sf):
    return _clusters(spark, sf).select("doc_name", "global_id", "canonical_name", "entity_type", F.array_join("mentions", "|").alias("mentions"))


@query("f9_case_pool", f"""{_TO_CLUST}, cm AS (SELECT case_id, canonical_name AS norm, doc_name, entity_type, unnest(mentions) AS mention, unnest(range(0, len(mentions))) AS pos, global_id FROM clust), cb AS (SELECT case_id, norm, mention, min({{'d': doc_name, 'g': global_id, 'p': pos}}) AS o, arg_min(entity_type, {{'d': doc_name, 'g': global_id, 'p': pos}}) AS t FROM cm GROUP BY ALL),
    cp AS (SELECT case_id, norm, min(o) AS o, arg_min(t, o) AS entity_type, string_agg(mention, '|' ORDER BY o) AS mentions FROM cb GROUP BY ALL) SELECT case_id, norm AS canonical_name, entity_type, mentions, row_number() OVER (PARTITION BY case_id ORDER BY o) AS global_id FROM cp""")  # fmt: skip
def f9(spark, sf):
    return casework.case_pool(_clusters(spark, sf)).select("case_id", F.col("norm").alias("canonical_name"), "entity_type", F.array_join("mentions", "|").alias("mentions"), "global_id")


@query("g2_pronoun_map", f"{_TO_UNIF} SELECT doc_name, pron AS pronoun, main FROM pm")
def g2(spark, sf):
    return casework.pronoun_map(_clusters(spark, sf)).select("doc_name", F.explode("pronouns").alias("pronoun", "main"))


@query("g5_unified_sentences", f"{_TO_UNIF} SELECT doc_name, sentence_id, text, unified FROM uni")
def g5(spark, sf):
    return _stages(spark, sf)["unified"].select("doc_name", "sentence_id", "text", "unified")


@query("h3_triples", f"{_TO_RELS} SELECT doc_name, sentence_id, subject, predicate, object FROM good")
def h3(spark, sf):
    st = _stages(spark, sf)
    return casework.good_triples(casework.triples(st["unified"]), st["entities"]).select("doc_name", "sentence_id", "subject", "predicate", "object")


@query("h7_refined_relations", f"{_TO_RELS} SELECT doc_name, sentence_id, subject, predicate, object, relation_type FROM rels")
def h7(spark, sf):
    return _stages(spark, sf)["relations"].select("doc_name", "sentence_id", "subject", "predicate", "object", "relation_type")


def _parsed(spark, sf):
    s = casework.sentences(casework.segments(_docs(spark, sf)))
    return s.select("doc_name", "sentence_id", parses.shallow("text").alias("tokens"))


@query("h1_dependency_triples")
def h1(spark, sf):
    return _parsed(spark, sf).select("doc_name", "sentence_id", F.inline(parses.triples("tokens")))


@query("h4_pattern_relations")
def h4(spark, sf):
    return _parsed(spark, sf).select("doc_name", "sentence_id", F.inline(parses.matches("tokens")))


@query("i2_sentence_times", f"{_TO_SENTS} SELECT doc_name, sentence_id, time AS time_raw FROM sents WHERE time IS NOT NULL")
def i2(spark, sf):
    return casework.sentences(casework.segments(_docs(spark, sf))).where("time is not null").select("doc_name", "sentence_id", F.col("time").alias("time_raw"))


@query("i7_case_events", f"{_TO_EVTS} SELECT event_id, description, subject, predicate, object, sentence_id, time_raw, time_resolved, array_to_string(participants, '|') AS participants, array_to_string(locations, '|') AS locations FROM evts")
def i7(spark, sf):
    e = _stages(spark, sf)["events"]
    return e.select("event_id", "description", "subject", "predicate", "object", "sentence_id", "time_raw", "time_resolved", F.array_join("participants", "|").alias("participants"), F.array_join("locations", "|").alias("locations"))


@query("j5_case_timeline", f"{_TO_EVTS} SELECT case_id, source_event, target_event FROM bef WHERE target_event IS NOT NULL")
def j5(spark, sf):
    return _stages(spark, sf)["timeline"]


@query("k8_case_nodes", f"{_TO_GRAPH} SELECT case_id, id, f.t AS type, f.x AS text, f.l AS label FROM nodes")
def k8(spark, sf):
    return _stages(spark, sf)["nodes"]


@query("k9_case_edges", f"{_TO_GRAPH} SELECT case_id, source, target, edge_type, doc_name FROM edges")
def k9(spark, sf):
    return _stages(spark, sf)["edges"]


def _ranks_sql(k: int) -> str:
    out = "ge AS (SELECT DISTINCT case_id, source AS s, target AS t FROM edges WHERE starts_with(source, 'ENT_') AND starts_with(target, 'ENT_')), gn AS (SELECT case_id, id FROM nodes WHERE f.t = 'Entity' UNION SELECT case_id, s FROM ge UNION SELECT case_id, t FROM ge), gc AS (SELECT case_id, count(*)::DOUBLE AS n FROM gn GROUP BY 1), gd AS (SELECT case_id, s AS id, count(*) AS deg FROM ge GROUP BY ALL), r0 AS (SELECT gn.*, gd.deg, n, 1.0 / n AS score FROM gn LEFT JOIN gd USING (case_id, id) JOIN gc USING (case_id))"
    for i in range(k):
        out += f", g{i} AS (SELECT e.case_id, e.t AS id, sum(r.score / r.deg) AS got FROM ge e JOIN r{i} r ON r.case_id = e.case_id AND r.id = e.s GROUP BY ALL), l{i} AS (SELECT case_id, coalesce(sum(score) FILTER (deg IS NULL), 0) AS lost FROM r{i} GROUP BY 1), r{i + 1} AS (SELECT r.case_id, r.id, r.deg, r.n, 0.15 / r.n + 0.85 * (coalesce(g.got, 0) + l.lost / r.n) AS score FROM r{i} r LEFT JOIN g{i} g USING (case_id, id) JOIN l{i} l USING (case_id))"
    return out


@query("k11_case_pagerank", f"{_TO_GRAPH}, {_ranks_sql(5)} SELECT case_id, id, round(score * n, 6) AS score FROM r5")
def k11(spark, sf):
    st = _stages(spark, sf)
    ranks = casework.entity_ranks(st["nodes"], st["edges"], iterations=5)
    n = ranks.groupBy("case_id").agg(F.count("*").alias("n"))
    return ranks.join(n, "case_id").select("case_id", "id", F.round(F.col("score") * F.col("n"), 6).alias("score"))


@query("k12_case_graph", f"{_TO_GRAPH} SELECT case_id, 'node' AS part, f.t AS kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT case_id, 'edge', edge_type, count(*) FROM edges GROUP BY ALL")
def k12(spark, sf):
    st = _stages(spark, sf)
    n = st["nodes"].groupBy("case_id", F.lit("node").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(st["edges"].groupBy("case_id", F.lit("edge").alias("part"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


@query("k13_case_export", f"""{_TO_EVTS} SELECT 'documents' AS part, doc_name, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'nodes_local_entities', doc_name, count(*) FROM ents GROUP BY ALL UNION ALL SELECT 'edges_relations', doc_name, count(*) FROM rels GROUP BY ALL UNION ALL SELECT 'edges_events', doc_name, count(*) FROM evts GROUP BY ALL""")
def k13(spark, sf):
    parts = casework.export(_stages(spark, sf))
    n = [parts[k].groupBy(F.lit(k).alias("part"), "doc_name").agg(F.count("*").alias("n")) for k in ("documents", "nodes_local_entities", "edges_relations", "edges_events")]
    return n[0].unionByName(n[1]).unionByName(n[2]).unionByName(n[3])


@query("n1_verify_pipeline", f"""{_TO_GRAPH}, ve AS (SELECT case_id, count(*) AS n FROM ents GROUP BY 1), vr AS (SELECT case_id, count(*) AS n FROM rels GROUP BY 1), vv AS (SELECT case_id, count(*) AS n FROM evts GROUP BY 1), vb AS (SELECT case_id, count(*) AS n FROM bef WHERE target_event IS NOT NULL GROUP BY 1), vg AS (SELECT case_id, count(*) AS n FROM edges GROUP BY 1)
    SELECT c.case_id, coalesce(ve.n, 0) AS n_entities, coalesce(vr.n, 0) AS n_relations, coalesce(vv.n, 0) AS n_events, coalesce(vb.n, 0) > 0 AS timeline_has_before_after, coalesce(ve.n, 0) > 0 AND coalesce(vr.n, 0) >= 5 AND coalesce(vv.n, 0) > 0 AND coalesce(vg.n, 0) > 0 AS passed
    FROM (SELECT DISTINCT case_id FROM docs WHERE case_id IS NOT NULL) c LEFT JOIN ve USING (case_id) LEFT JOIN vr USING (case_id) LEFT JOIN vv USING (case_id) LEFT JOIN vb USING (case_id) LEFT JOIN vg USING (case_id)""")  # fmt: skip
def n1(spark, sf):
    return casework.verify(_stages(spark, sf)).where("case_id is not null").select("case_id", "n_entities", "n_relations", "n_events", "timeline_has_before_after", "passed")


@query("l9_drawn_graph", f"{_TO_GRAPH} SELECT case_id, id, CASE f.t WHEN 'Entity' THEN 'skyblue' WHEN 'Event' THEN 'lightcoral' WHEN 'Location' THEN 'lightgreen' ELSE 'gray' END AS color, 500.0::DOUBLE AS size FROM nodes")
def l9(spark, sf):
    n = _stages(spark, sf)["nodes"]
    return graph.drawn(n.withColumn("score", F.lit(0.0))).select("case_id", "id", "color", "size")


@query("k7_endpoints", f"SELECT rel_id, {_end('s')} AS source, {_end('o', _MORE)} AS target FROM (SELECT rel_id, lower({sql_squeeze('subject_text')}) AS s, lower({sql_squeeze('object_text')}) AS o FROM edges_relations WHERE trim(subject_text, ' ') <> '' AND trim(object_text, ' ') <> '')")
def k7(spark, sf):
    from inkgraph.functions import fixed

    r = table(spark, sf, "edges_relations").where("trim(subject_text) != '' and trim(object_text) != ''")
    return r.select("rel_id", graph.canonical_end(text.graph_norm(F.col("subject_text")), fixed.ENDPOINT_RULES).alias("source"), graph.canonical_end(text.graph_norm(F.col("object_text")), [*fixed.ENDPOINT_RULES, *fixed.OBJECT_ENDPOINT_RULES]).alias("target"))


@query("m4_refined_edges", "SELECT source_id, target_id, edge_type, min(edge_id) AS edge_id FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND edge_type IS NOT NULL GROUP BY ALL")
def m4(spark, sf):
    e = table(spark, sf, "graph_edges").select("edge_id", "source_id", "target_id", "edge_type")
    return graph.dedupe_edges(providers.refine(e, "edge_id", providers.identity)).select("source_id", "target_id", "edge_type", "edge_id")


@query("r3_conformed_entities", "SELECT id, case_id, entity_type, entity_name, normalized_name, global_id FROM entities")
def r3(spark, sf):
    return models.conform(table(spark, sf, "entities"), "entities")


@query("r2_broken_keys", """SELECT 'entities' AS child, 'global_id' AS key, count(*) AS n FROM entities WHERE global_id IS NOT NULL AND global_id NOT IN (SELECT global_id FROM global_entities) UNION ALL SELECT 'relations', 'subject_id', count(*) FROM edges_relations WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM entities)
    UNION ALL SELECT 'relations', 'object_id', count(*) FROM edges_relations WHERE object_id IS NOT NULL AND object_id NOT IN (SELECT id FROM entities)""")
def r2(spark, sf):
    return models.broken({"entities": table(spark, sf, "entities"), "global_entities": table(spark, sf, "global_entities"), "relations": table(spark, sf, "edges_relations")})
