"""Queries of the core operators with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions import fixed, text
from inkgraph.operators import entities as ent
from inkgraph.operators import events as ev
from inkgraph.operators import graph, quality, relations, segment, web
from inkgraph.operators.ordered import position
from inkgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def q(s: str) -> str:
    """A pattern or text inside SQL quotes; the flag for Unicode case is a default there."""
    return s.replace("'", "''").replace("(?iu)", "(?i)")


# --- SQL pieces -------------------------------------------------------------------------------------------------
def sql_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_narrative(c: str) -> str:
    c = rf"regexp_replace({c}, '(?im)^REPORTING OFFICER[''’]S NARRATIVE[^\n]*$', '', 'g')"
    c = rf"regexp_replace({sql_squeeze(c)}, '(^|[^R])EPORTING', '\1REPORTING', 'g')"
    return rf"regexp_replace(replace({c}, 'º', '°'), '\s*/\s*', ' / ', 'g')"


def sql_expand(c: str) -> str:
    for p, full in fixed.ABBREVIATIONS:
        c = f"regexp_replace({c}, '{p}', '{full}', 'g')"
    return c


SQL_NER = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
SQL_COREF = "replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' ', '_')"
SQL_WORDS = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END".format(sql_squeeze("text"))
SQL_TOKENS = f"greatest(1, floor(({SQL_WORDS}) * 1.2))::BIGINT"


# --- normalisation ----------------------------------------------------------------------------------------------
@query("b1_narrative_norm", f"SELECT id, {sql_narrative('text')} AS norm FROM narratives WHERE text IS NOT NULL")
def b1(spark, sf):
    return table(spark, sf, "narratives").where("text is not null").select("id", text.narrative(F.col("text")).alias("norm"))


@query("b2_abbreviations", f"SELECT id, {sql_expand(sql_narrative('text'))} AS expanded FROM narratives WHERE text IS NOT NULL")
def b2(spark, sf):
    return table(spark, sf, "narratives").where("text is not null").select("id", text.expand(text.narrative(F.col("text"))).alias("expanded"))


@query("b4_biography_norm", r"SELECT id, trim(regexp_replace(regexp_replace(replace(biography, chr(13)||chr(10), chr(10)), '\n{3,}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g')) AS norm FROM victim_biographies WHERE biography IS NOT NULL")
def b4(spark, sf):
    return table(spark, sf, "victim_biographies").where("biography is not null").select("id", text.biography(F.col("biography")).alias("norm"))


@query("b5_interview_norm", r"SELECT id, trim(regexp_replace(regexp_replace(replace(interview_text, chr(13)||chr(10), chr(10)), '\n{2,}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g')) AS norm FROM suspect_interviews WHERE interview_text IS NOT NULL")
def b5(spark, sf):
    return table(spark, sf, "suspect_interviews").where("interview_text is not null").select("id", text.interview(F.col("interview_text")).alias("norm"))


@query("b6_name_norms", f"""SELECT id, {SQL_NER.format('entity_name')} AS ner, {SQL_COREF.format('entity_name')} AS coref, replace(lower(entity_name), ' ', '_') AS cluster,
    'ENT_' || replace(lower({sql_squeeze('entity_name')}), ' ', '_') AS ent_id, coalesce(replace(lower(entity_name), ' ', '_'), 'unknown') AS refined FROM entities""")
def b6(spark, sf):
    c = F.col("entity_name")
    return table(spark, sf, "entities").select("id", text.ner_norm(c).alias("ner"), text.coref_norm(c).alias("coref"), text.cluster_norm(c).alias("cluster"), text.entity_id(c).alias("ent_id"), text.refine_norm(c).alias("refined"))


@query("b10_predicate_norm", "SELECT lower(trim(predicate, ' ')) AS predicate, count(*) AS n FROM edges_relations GROUP BY 1")
def b10(spark, sf):
    return table(spark, sf, "edges_relations").groupBy(F.lower(F.trim("predicate")).alias("predicate")).agg(F.count("*").alias("n"))


@query("b12_token_estimate", f"SELECT doc_id, ({SQL_WORDS})::BIGINT AS words, {SQL_TOKENS} AS tokens FROM documents WHERE text IS NOT NULL")
def b12(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.word_count(c).cast("bigint").alias("words"), text.token_estimate(c).alias("tokens"))


@query("b13_trim_to_budget", f"""SELECT doc_id, CASE WHEN tok <= 40 THEN sq ELSE array_to_string(string_split(sq, ' ')[1:greatest(1, floor(40.0 / tok * words))::INT], ' ') || '...' END AS trimmed
    FROM (SELECT doc_id, {sql_squeeze('text')} AS sq, ({SQL_WORDS}) AS words, {SQL_TOKENS} AS tok FROM documents WHERE text IS NOT NULL)""")
def b13(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.within_budget(F.col("text"), 40).alias("trimmed"))


_LINKS = ["'/' || source", "'contact'", "'#top'", "'javascript:void(0)'", "'https://other.example/' || doc_id || '#part'", "'//cdn.example/x'", "''", "'mailto:a@b.example'"]


@query("b14_links", f"""WITH l AS (SELECT doc_id, 'https://' || replace(source, '_', '-') || '.example' AS base, unnest([{', '.join(_LINKS)}]) AS href FROM documents WHERE source IS NOT NULL),
    h AS (SELECT *, regexp_replace(trim(href), '#.*$', '') AS h FROM l)
    SELECT doc_id, href, CASE WHEN trim(href) = '' OR h = '' THEN NULL WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h
      WHEN regexp_matches(h, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(h, '/') THEN base || h ELSE base || '/' || h END AS link FROM h""")
def b14(spark, sf):
    base = F.concat(F.lit("https://"), F.replace("source", F.lit("_"), F.lit("-")), F.lit(".example"))
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", base.alias("base"), F.explode(F.array(*[F.expr(x) for x in _LINKS])).alias("href"))
    return d.select("doc_id", "href", text.absolute_link(F.col("href"), F.col("base")).alias("link"))


@query("b15_fenced_json", r"""SELECT event_id, json_extract(trim(regexp_replace(regexp_replace('```json' || chr(10) || props || chr(10) || '```', '^```[A-Za-z]*\s*', ''), '\s*```$', '')), '$.k')::BIGINT AS k FROM events""")
def b15(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.unfenced(fenced), "$.k").cast("bigint").alias("k"))


@query("a3_title", r"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS title FROM documents WHERE text IS NOT NULL")
def a3(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.first_line(F.col("text")).alias("title"))


@query("a2_doc_type", """SELECT t, count(*) AS n FROM (SELECT CASE WHEN contains(f, 'incidentreport') OR contains(f, 'narrative') THEN 'narrative' WHEN starts_with(f, 'bio_') THEN 'biography' WHEN starts_with(f, 'interview_') THEN 'interview' END AS t
    FROM (SELECT lower(CASE doc_type WHEN 'biography' THEN 'BIO_' WHEN 'interview' THEN 'Interview_' WHEN 'narrative' THEN 'IncidentReport_' ELSE 'Page_' END || case_id) AS f FROM documents)) GROUP BY t""")
def a2(spark, sf):
    name = F.concat(F.when(F.col("doc_type") == "biography", "BIO_").when(F.col("doc_type") == "interview", "Interview_").when(F.col("doc_type") == "narrative", "IncidentReport_").otherwise("Page_"), "case_id")
    return table(spark, sf, "documents").select(text.doc_type_of(name).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


# --- segmentation -----------------------------------------------------------------------------------------------
_SEG = q(fixed.SEGMENT)


@query("c1_segments", f"""WITH p AS (SELECT id, string_split(regexp_replace({sql_expand(sql_narrative('text'))}, '{_SEG}', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM narratives WHERE text IS NOT NULL),
    s AS (SELECT id, unnest(range(0, len(parts))) AS seg_idx, parts FROM p), r AS (SELECT id, seg_idx, parts[seg_idx + 1] AS raw FROM s)
    SELECT id, seg_idx::INT AS seg_idx, nullif(regexp_extract(regexp_extract(raw, '(?i)^{_SEG[4:]}', 1), '{q(fixed.CLOCK)}', 0), '') AS time, trim(raw) AS text FROM r WHERE trim(raw) <> ''""")
def c1(spark, sf):
    return segment.segments(table(spark, sf, "narratives").where("text is not null"), "id", "text")


@query("c2_paragraphs", rf"""WITH p AS (SELECT id, regexp_split_to_array(trim(regexp_replace(regexp_replace(replace(biography, chr(13)||chr(10), chr(10)), '\n{{3,}}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g')), '\n\s*\n') AS parts FROM victim_biographies WHERE biography IS NOT NULL),
    s AS (SELECT id, unnest(range(0, len(parts))) AS par_idx, parts FROM p) SELECT id, par_idx::INT AS par_idx, {sql_squeeze('parts[par_idx + 1]')} AS text FROM s WHERE {sql_squeeze('parts[par_idx + 1]')} <> ''""")
def c2(spark, sf):
    return segment.paragraphs(table(spark, sf, "victim_biographies").where("biography is not null"), "id", "biography")


@query("c3_header", "SELECT id, l[1] AS title, l[2] AS header_time FROM (SELECT id, list_filter(list_transform(string_split(interview_text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM suspect_interviews WHERE interview_text IS NOT NULL)")
def c3(spark, sf):
    return table(spark, sf, "suspect_interviews").where("interview_text is not null").select("id", segment.header(F.col("interview_text")).alias("h")).select("id", "h.*")


@query("c5_colon_turns", """WITH l AS (SELECT id, unnest(range(0, len(ls))) AS pos, ls FROM (SELECT id, string_split(replace(interview_text, chr(13)||chr(10), chr(10)), chr(10)) AS ls FROM suspect_interviews WHERE interview_text IS NOT NULL)),
    x AS (SELECT id, pos, trim(ls[pos + 1]) AS line FROM l), y AS (SELECT *, regexp_matches(line, '^[^:]+:') AS opens FROM x WHERE line <> ''),
    z AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY pos) AS turn FROM y)
    SELECT id, turn::BIGINT AS turn, coalesce(max(CASE WHEN opens THEN trim(regexp_extract(line, '^([^:]+):', 1)) END), 'NARRATOR') AS speaker,
      trim(string_agg(CASE WHEN opens THEN trim(regexp_replace(line, '^[^:]+:', '')) ELSE line END, ' ' ORDER BY pos)) AS text FROM z GROUP BY id, turn HAVING trim(string_agg(CASE WHEN opens THEN trim(regexp_replace(line, '^[^:]+:', '')) ELSE line END, ' ' ORDER BY pos)) <> ''""")
def c5(spark, sf):
    return segment.colon_turns(table(spark, sf, "suspect_interviews").where("interview_text is not null"), "id", "interview_text")


_SENTS = rf"""s0 AS (SELECT id, string_split(regexp_replace({sql_squeeze('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM narratives WHERE text IS NOT NULL),
    s AS (SELECT id, sent_idx, parts[sent_idx + 1] AS text FROM (SELECT id, unnest(range(0, len(parts))) AS sent_idx, parts FROM s0) WHERE parts[sent_idx + 1] <> '')"""


def _sentences(spark, sf):
    return segment.sentences(table(spark, sf, "narratives").where("text is not null"), ["id"], "text")


@query("c6_sentences", f"WITH {_SENTS} SELECT id, sent_idx::INT AS sent_idx, text FROM s")
def c6(spark, sf):
    return _sentences(spark, sf)


@query("c7_flags", f"WITH {_SENTS} SELECT id, sent_idx::INT AS sent_idx, regexp_matches(text, '{q(fixed.CLOCK)}') AS has_time, regexp_matches(text, '{q(fixed.ACTOR)}') AS has_actor, regexp_matches(text, '{q(fixed.SURROUNDINGS)}') AS has_env FROM s")
def c7(spark, sf):
    return _sentences(spark, sf).select("id", "sent_idx", *[c.alias(n) for n, c in segment.flags(F.col("text")).items()])


@query("c8_merged_sentences", f"""WITH {_SENTS}, f AS (SELECT *, len(string_split(text, ' ')) < 3 AND NOT regexp_matches(text, '[.!?]$') AS short FROM s),
    n AS (SELECT id, sent_idx, text, short, lead(text) OVER w AS nt, row_number() OVER w - 1 - coalesce(max(CASE WHEN NOT short THEN rn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sent_idx) AS rn FROM f) WINDOW w AS (PARTITION BY id ORDER BY sent_idx))
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY sent_idx) - 1)::INT AS idx, CASE WHEN short AND nt IS NOT NULL THEN text || ' ' || nt ELSE text END AS text FROM n WHERE run % 2 = 0""")
def c8(spark, sf):
    s = _sentences(spark, sf).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))), lambda x: x["text"]).alias("ss"))
    return s.select("id", F.posexplode(segment.merge_fragments(F.col("ss"))).alias("idx", "text"))


@query("c11_sentence_ids", f"WITH {_SENTS} SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY sent_idx) - 1 AS sentence_id FROM s")
def c11(spark, sf):
    return segment.sentence_ids(_sentences(spark, sf), "id", ["sent_idx"]).select("id", "text", "sentence_id")


@query("p3_inline_dates", f"SELECT id, regexp_extract(biography, '{q(fixed.INLINE_DATE)}', 0) AS first_date FROM victim_biographies WHERE regexp_matches(biography, '{q(fixed.INLINE_DATE)}')".replace("p3_", ""))
def p3(spark, sf):
    return table(spark, sf, "victim_biographies").where(F.col("biography").rlike(fixed.INLINE_DATE)).select("id", F.regexp_extract("biography", fixed.INLINE_DATE, 0).alias("first_date"))


# the letter p is kept for the ten problems
QUERIES["pred3_inline_dates"], SQL["pred3_inline_dates"] = QUERIES.pop("p3_inline_dates"), SQL.pop("p3_inline_dates")


@query("e1_gazetteer", "WITH h AS (SELECT id, unnest(regexp_extract_all(" + sql_expand(sql_narrative("text")) + r", '\b(" + q("|".join(p for p, _ in sorted(fixed.GAZETTEER, key=lambda p: -len(p[0])))) + r")\b', 1)) AS phrase FROM narratives WHERE text IS NOT NULL) SELECT id, phrase, count(*) AS n, CASE phrase " + " ".join(f"WHEN '{q(p)}' THEN '{label}'" for p, label in fixed.GAZETTEER) + " END AS label FROM h GROUP BY id, phrase")
def e1(spark, sf):
    d = table(spark, sf, "narratives").where("text is not null").select("id", text.expand(text.narrative(F.col("text"))).alias("t"))
    return segment.gazetteer(d, "id", "t")


# --- entities ---------------------------------------------------------------------------------------------------
def _mentions(spark, sf):
    e = table(spark, sf, "entities").where("trim(entity_name) != ''")
    return e.select("case_id", text.coref_norm(F.col("entity_name")).alias("norm"), F.trim("entity_name").alias("mention"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("label"), F.coalesce("doc_name", F.lit("")).alias("source"), F.col("id").alias("ord")).where("norm != ''")


_POOL = f"""m AS (SELECT case_id, {SQL_COREF.format('entity_name')} AS norm, trim(entity_name) AS mention, coalesce(entity_type, 'UNKNOWN') AS label, coalesce(doc_name, '') AS source, id AS ord FROM entities WHERE trim(entity_name) <> ''),
    bm AS (SELECT case_id, norm, mention, min(ord) AS o, arg_min(label, ord) AS label FROM m WHERE norm <> '' GROUP BY ALL), bs AS (SELECT case_id, norm, source, min(ord) AS o FROM m WHERE norm <> '' GROUP BY ALL),
    a AS (SELECT case_id, norm, min(o) AS first_ord, arg_min(label, o) AS entity_type, string_agg(mention, '|' ORDER BY o) AS mentions FROM bm GROUP BY case_id, norm),
    b AS (SELECT case_id, norm, string_agg(source, '|' ORDER BY o) AS sources FROM bs GROUP BY case_id, norm),
    pool AS (SELECT case_id, norm, entity_type, mentions, sources, row_number() OVER (PARTITION BY case_id ORDER BY first_ord) AS global_id FROM a JOIN b USING (case_id, norm))"""


@query("f1_entity_pool", f"WITH {_POOL} SELECT * FROM pool")
def f1(spark, sf):
    p = ent.pool(_mentions(spark, sf), ["case_id"])
    return p.select("case_id", "norm", "entity_type", F.array_join("mentions", "|").alias("mentions"), F.array_join("source_docs", "|").alias("sources"), "global_id")


_PRON = ", ".join(f"'{p}'" for p in fixed.PRONOUNS)


@query("f2_pronoun_asof", rf"""WITH t AS (SELECT id, unnest(range(0, len(w))) AS idx, w FROM (SELECT id, string_split({sql_squeeze('text')}, ' ') AS w FROM narratives WHERE text IS NOT NULL)),
    x AS (SELECT id, idx, w[idx + 1] AS token, CASE WHEN idx > 0 AND w[idx] IN ('Mr.', 'Ms.', 'Dr.') THEN regexp_replace(w[idx + 1], '[.,;:!?”"]+$', '') END AS mention FROM t),
    y AS (SELECT id, idx, lower(regexp_replace(token, '[^A-Za-z]', '', 'g')) AS pronoun, last_value(mention IGNORE NULLS) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM x)
    SELECT id, idx::INT AS idx, pronoun, antecedent FROM y WHERE pronoun IN ('he', 'him', 'his', 'she', 'her', 'hers', 'they', 'them', 'their', 'theirs') AND antecedent IS NOT NULL""")
def f2(spark, sf):
    words = F.split(text.squeeze(F.col("text")), " ")
    t = table(spark, sf, "narratives").where("text is not null").select("id", words.alias("w")).select("id", "w", F.posexplode("w").alias("idx", "token"))
    prev = F.when(F.col("idx") > 0, F.get("w", F.col("idx") - 1))
    t = t.select("id", "idx", "token", F.when(prev.isin("Mr.", "Ms.", "Dr."), F.regexp_replace("token", r'[.,;:!?”"]+$', "")).alias("mention"))
    return ent.resolve_pronouns(t, "id")


_GROUPS = [["bank", "savings"], ["school"], ["medical"]]
_MERGE = "pool"
for _i, _g in enumerate(_GROUPS):
    _MERGE = f"(SELECT * EXCLUDE (gid), CASE WHEN h THEN min(CASE WHEN h THEN gid END) OVER (PARTITION BY case_id) ELSE gid END AS gid FROM (SELECT * EXCLUDE (h), regexp_matches(norm, '(^|_)({'|'.join(_g)})(_|$)') AS h FROM {_MERGE if _i else '(SELECT *, global_id AS gid, false AS h FROM pool)'}))"


@query("f4_constrained_merge", f"WITH {_POOL} SELECT case_id, norm, global_id, gid AS into_id FROM {_MERGE}")
def f4(spark, sf):
    p = ent.pool(_mentions(spark, sf), ["case_id"])
    return ent.merge_by_words(p, ["case_id"], _GROUPS).select("case_id", "norm", "global_id", F.col("into").alias("into_id"))


@query("g1_main_mention", f"""WITH m AS (SELECT global_id, unnest(range(0, len(mentions))) AS pos, mentions FROM global_entities), x AS (SELECT global_id, pos, mentions[pos + 1] AS mention FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY length(mention) DESC, pos) AS k FROM x WHERE mention IS NOT NULL AND lower(trim(mention)) NOT IN ({_PRON}))
    SELECT g.global_id, r.mention AS main_mention FROM global_entities g LEFT JOIN r ON r.global_id = g.global_id AND r.k = 1""")
def g1(spark, sf):
    return table(spark, sf, "global_entities").select("global_id", ent.main_mention(F.col("mentions")).alias("main_mention"))


_GREP = "biography"
for _p in sorted(["she", "he", "her", "him"], key=lambda x: -len(x)):
    _GREP = rf"regexp_replace({_GREP}, '(?i)(^|[^\p{{L}}\p{{N}}_]){_p}($|[^\p{{L}}\p{{N}}_])', '\1' || victim_name || '\2', 'g')"


@query("g3_replace_pronouns", f"SELECT id, {_GREP} AS resolved FROM victim_biographies WHERE biography IS NOT NULL AND victim_name IS NOT NULL")
def g3(spark, sf):
    d = table(spark, sf, "victim_biographies").where("biography is not null and victim_name is not null")
    return d.select("id", ent.replace_pronouns(F.col("biography"), [(p, F.col("victim_name")) for p in ("she", "he", "her", "him")]).alias("resolved"))


# --- relations and events ---------------------------------------------------------------------------------------
@query("h2_entity_index", "SELECT r.rel_id, s.entity_name AS subject_name, s.entity_type AS subject_type, o.entity_name AS object_name, o.entity_type AS object_type FROM edges_relations r LEFT JOIN entities s ON s.id = r.subject_id LEFT JOIN entities o ON o.id = r.object_id")
def h2(spark, sf):
    return relations.entity_index(table(spark, sf, "edges_relations"), table(spark, sf, "entities")).select("rel_id", "subject_name", "subject_type", "object_name", "object_type")


_TYPE = "CASE lower(trim(predicate, ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.VERB_TYPES.items()) + " END"


@query("h6_relation_types", f"SELECT relation, edge, count(*) AS n FROM (SELECT t AS relation, CASE t WHEN 'REMOVED' THEN 'OBSERVED' WHEN 'TOLD' THEN NULL ELSE t END AS edge FROM (SELECT {_TYPE} AS t FROM edges_relations) WHERE t IS NOT NULL) GROUP BY ALL")
def h6(spark, sf):
    r = table(spark, sf, "edges_relations").select(relations.relation_type(F.col("predicate")).alias("relation")).where(F.col("relation").isNotNull())
    return r.select("relation", relations.edge_type(F.col("relation")).alias("edge")).groupBy("relation", "edge").agg(F.count("*").alias("n"))


@query("pred5_quality_filter", r"""WITH e AS (SELECT DISTINCT case_id, doc_name, lower(trim(entity_name)) AS name FROM entities WHERE trim(entity_name) <> '')
    SELECT rel_id FROM edges_relations r WHERE len(regexp_split_to_array(trim(subject_text), '\s+')) <= 15 AND len(regexp_split_to_array(trim(object_text), '\s+')) <= 15
      AND (NOT EXISTS (SELECT 1 FROM e WHERE e.case_id = r.case_id AND e.doc_name = r.doc_name) OR EXISTS (SELECT 1 FROM e WHERE e.case_id = r.case_id AND e.doc_name = r.doc_name AND (contains(lower(r.subject_text), e.name) OR contains(lower(r.object_text), e.name))))""")
def pred5(spark, sf):
    return relations.short_and_named(table(spark, sf, "edges_relations"), table(spark, sf, "entities")).select("rel_id")


@query("i1_event_candidates", f"""WITH {_SENTS} SELECT id, sent_idx::INT AS sent_idx, nullif(regexp_extract(text, '{q(fixed.CLOCK)}', 0), '') AS time_raw,
    CASE WHEN contains(lower(text), 'arrived') THEN 'arrival' WHEN contains(lower(text), 'reported') THEN 'report' WHEN contains(lower(text), 'observed') THEN 'observation' WHEN contains(lower(text), 'pronounced') THEN 'pronouncement' ELSE 'unknown' END AS category
    FROM s WHERE regexp_matches(text, '{q(fixed.CLOCK)}') OR regexp_matches(text, '{q(fixed.EVENT_VERBS)}')""")
def i1(spark, sf):
    return ev.candidates(_sentences(spark, sf)).select("id", "sent_idx", "time_raw", "category")


@query("i3_relation_events", """WITH s AS (SELECT case_id, doc_name, sentence_id, arg_min(description, id) AS description FROM case_events WHERE sentence_id IS NOT NULL AND doc_name IS NOT NULL AND description IS NOT NULL GROUP BY ALL)
    SELECT r.rel_id, s.description FROM edges_relations r JOIN s ON s.case_id = r.case_id AND s.doc_name = r.doc_name AND s.sentence_id = r.sentence_id""")
def i3(spark, sf):
    s = table(spark, sf, "case_events").where("sentence_id is not null and doc_name is not null and description is not null").groupBy("case_id", "doc_name", "sentence_id").agg(F.min_by("description", "id").alias("description"))
    return table(spark, sf, "edges_relations").join(s, ["case_id", "doc_name", "sentence_id"]).select("rel_id", "description")


_PART = "(SELECT DISTINCT e.id AS event, trim(n.entity_name) AS participant FROM (SELECT id, unnest(entities_involved) AS ent FROM case_events) e JOIN entities n ON n.id = e.ent WHERE upper(n.entity_type) IN ('PERSON', 'ROLE', 'ORG', 'EVIDENCE') AND trim(n.entity_name) <> '')"
_LOC = f"""(SELECT event, unnest(list_distinct(list_concat(CASE WHEN lower(trim(place)) <> '' THEN [lower(trim(place))] ELSE [] END, coalesce(list_filter([{', '.join(f"'{q(w)}'" for w in fixed.PLACE_WORDS)}], lambda w: contains(lower(description), w)), [])))) AS location FROM (SELECT id AS event, place, description FROM case_events)
    UNION SELECT e.id, lower(trim(n.entity_name, ' ')) FROM (SELECT id, unnest(entities_involved) AS ent FROM case_events) e JOIN entities n ON n.id = e.ent WHERE upper(n.entity_type) = 'LOC' AND trim(n.entity_name, ' ') <> '')"""


@query("i5_participants", f"SELECT event, participant FROM {_PART}")
def i5(spark, sf):
    return ev.participants(table(spark, sf, "case_events"), table(spark, sf, "entities"))


@query("i5_locations", f"SELECT event, location FROM {_LOC}")
def i5b(spark, sf):
    return ev.locations(table(spark, sf, "case_events"), table(spark, sf, "entities"))


@query("i6_event_ids", "SELECT id, row_number() OVER (PARTITION BY case_id, doc_name ORDER BY id) AS event_no FROM case_events WHERE doc_name IS NOT NULL")
def i6(spark, sf):
    return ev.number_in_doc(table(spark, sf, "case_events").where("doc_name is not null"), ["case_id", "doc_name"], ["id"]).select("id", "event_no")


_ISO = r"""(SELECT id, case_id, CASE WHEN h BETWEEN 1 AND 12 AND m BETWEEN 0 AND 59 AND case_date IS NOT NULL THEN printf('%sT%02d:%02d:00', case_date::VARCHAR, h % 12 + CASE WHEN p = 'p' THEN 12 ELSE 0 END, m) END AS iso
    FROM (SELECT id, case_id, case_date, TRY_CAST(g[1] AS INT) AS h, TRY_CAST(g[2] AS INT) AS m, lower(g[3]) AS p FROM (SELECT id, case_id, case_date, [regexp_extract(time_raw, PAT, 1), regexp_extract(time_raw, PAT, 2), regexp_extract(time_raw, PAT, 3)] AS g FROM case_events)))"""
_LENIENT = r"(?i)\b(\d{1,2})[:.](\d{2})\s*([ap])\.?\s*m"
_STRICT = r"(?i)\b(\d{1,2})[:.](\d{2})\s*([ap])m\b"


@query("j1_clock_to_iso", f"SELECT a.id, a.iso AS lenient, b.iso AS strict FROM {_ISO.replace('PAT', f'{chr(39)}{_LENIENT}{chr(39)}')} a JOIN {_ISO.replace('PAT', f'{chr(39)}{_STRICT}{chr(39)}')} b USING (id)")
def j1(spark, sf):
    return table(spark, sf, "case_events").select("id", ev.clock_to_iso(F.col("time_raw"), F.col("case_date")).alias("lenient"), ev.clock_to_iso(F.col("time_raw"), F.col("case_date"), strict=True).alias("strict"))


_BEFORE = f"(SELECT case_id, id AS source_event, lead(id) OVER (PARTITION BY case_id ORDER BY iso, id) AS target_event FROM {_ISO.replace('PAT', f'{chr(39)}{_LENIENT}{chr(39)}')} WHERE iso IS NOT NULL)"


def _timed(spark, sf):
    return table(spark, sf, "case_events").select("id", "case_id", ev.clock_to_iso(F.col("time_raw"), F.col("case_date")).alias("time_resolved"))


@query("j4_before_edges", f"SELECT * FROM {_BEFORE} WHERE target_event IS NOT NULL")
def j4(spark, sf):
    return ev.before_edges(_timed(spark, sf))


# --- graph ------------------------------------------------------------------------------------------------------
@query("k1_entity_nodes", f"SELECT case_id, ent_id, arg_min(name, id) AS text, arg_min(label, id) AS label FROM (SELECT id, case_id, trim(entity_name) AS name, coalesce(entity_type, 'Unknown') AS label, 'ENT_' || replace(lower({sql_squeeze('entity_name')}), ' ', '_') AS ent_id FROM entities WHERE trim(entity_name) <> '') GROUP BY case_id, ent_id")
def k1(spark, sf):
    e = table(spark, sf, "entities").where("trim(entity_name) != ''").select("id", "case_id", F.trim("entity_name").alias("text"), F.coalesce("entity_type", F.lit("Unknown")).alias("label"), text.entity_id(F.col("entity_name")).alias("ent_id"))
    return graph.first_by(e, ["case_id", "ent_id"], "id", ["text", "label"])


@query("k3_event_edges", f"""SELECT event_type, source_id, target_id FROM (
    SELECT 'PARTICIPATED_IN' AS event_type, 'ENT_' || replace(lower({sql_squeeze('participant')}), ' ', '_') AS source_id, event::VARCHAR AS target_id FROM {_PART}
    UNION ALL SELECT 'LOCATED_AT', event::VARCHAR, 'LOC_' || replace(lower({sql_squeeze('location')}), ' ', '_') FROM {_LOC}
    UNION ALL SELECT 'HAS_TIME', id::VARCHAR, 'TIME_' || regexp_replace(iso, '[:T-]', '', 'g') FROM {_ISO.replace('PAT', f'{chr(39)}{_LENIENT}{chr(39)}')} WHERE iso IS NOT NULL)""")
def k3(spark, sf):
    events = table(spark, sf, "case_events")
    p = ev.participants(events, table(spark, sf, "entities")).select(F.lit("PARTICIPATED_IN").alias("event_type"), text.entity_id(F.col("participant")).alias("source_id"), F.col("event").cast("string").alias("target_id"))
    loc = ev.locations(events, table(spark, sf, "entities")).select(F.lit("LOCATED_AT").alias("event_type"), F.col("event").cast("string").alias("source_id"), text.entity_id(F.col("location"), "LOC_").alias("target_id"))
    t = _timed(spark, sf).where("time_resolved is not null").select(F.lit("HAS_TIME").alias("event_type"), F.col("id").cast("string").alias("source_id"), text.time_id(F.col("time_resolved")).alias("target_id"))
    return p.unionByName(loc).unionByName(t)


@query("k6_before_after", f"SELECT edge_type, source, target FROM (SELECT unnest(['BEFORE', 'AFTER']) AS edge_type, unnest([source_event, target_event]) AS source, unnest([target_event, source_event]) AS target FROM {_BEFORE} WHERE target_event IS NOT NULL)")
def k6(spark, sf):
    b = ev.before_edges(_timed(spark, sf))
    both = F.array(F.struct(F.lit("BEFORE").alias("edge_type"), F.col("source_event").alias("source"), F.col("target_event").alias("target")), F.struct(F.lit("AFTER").alias("edge_type"), F.col("target_event").alias("source"), F.col("source_event").alias("target")))
    return b.select(F.explode(both).alias("e")).select("e.*")


def _pagerank_sql(k: int) -> str:
    out = "e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), n AS (SELECT s AS id FROM e UNION SELECT t FROM e), c AS (SELECT count(*)::DOUBLE AS n FROM n), d AS (SELECT s AS id, count(*) AS deg FROM e GROUP BY s), r0 AS (SELECT n.id, d.deg, 1.0 / c.n AS score FROM n LEFT JOIN d USING (id) CROSS JOIN c)"
    for i in range(k):
        out += f", g{i} AS (SELECT e.t AS id, sum(r.score / r.deg) AS got FROM e JOIN r{i} r ON r.id = e.s GROUP BY e.t), l{i} AS (SELECT coalesce(sum(score), 0) AS lost FROM r{i} WHERE deg IS NULL), r{i + 1} AS (SELECT r.id, r.deg, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS score FROM r{i} r LEFT JOIN g{i} g USING (id) CROSS JOIN l{i} l CROSS JOIN c)"
    return out


@query("l1_pagerank", f"WITH {_pagerank_sql(5)} SELECT r.id, round(r.score * c.n, 6) AS score FROM r5 r CROSS JOIN c")
def l1(spark, sf):
    s = graph.pagerank(table(spark, sf, "graph_edges"), iterations=5)
    return s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).select("id", F.round(F.col("score") * F.col("n"), 6).alias("score"))


@query("l1_pagerank_converged")
def l1c(spark, sf):
    return graph.pagerank(table(spark, sf, "graph_edges")).select("id", "score")


_DEG = "a AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL), d AS (SELECT id, count(*) AS deg FROM (SELECT s AS id FROM a UNION ALL SELECT t FROM a) GROUP BY id), sc AS (SELECT id, deg / ((SELECT count(*) FROM d) - 1)::DOUBLE AS score FROM d), st AS (SELECT count(*) AS n, min(score) AS lo, max(score) AS hi, avg(score) AS mean, median(score) AS median, stddev_samp(score) AS sd FROM sc), th AS (SELECT *, CASE WHEN n > 10 THEN mean + 0.5 * sd ELSE 0.3 * hi END AS threshold FROM st), rk AS (SELECT sc.id, sc.score, sc.score >= th.threshold AS is_significant FROM sc, th)"


def _scores(spark, sf):
    return graph.degree_centrality(table(spark, sf, "graph_edges"))


@query("l2_degree_centrality", f"WITH {_DEG} SELECT id, round(score, 9) AS score FROM sc")
def l2(spark, sf):
    return _scores(spark, sf).select("id", F.round("score", 9).alias("score"))


@query("l3_score_stats", f"WITH {_DEG} SELECT n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(threshold, 6) AS threshold FROM th")
def l3(spark, sf):
    return graph.score_stats(_scores(spark, sf)).select("n", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "median", "sd", "threshold")])


_PR = f"{_pagerank_sql(5)}, sc AS (SELECT id, score FROM r5), st AS (SELECT count(*) AS n, avg(score) + 0.5 * stddev_samp(score) AS a, 0.3 * max(score) AS b FROM sc), rk AS (SELECT sc.id, sc.score, sc.score >= CASE WHEN n > 10 THEN a ELSE b END AS is_significant FROM sc, st)"
_NODES = "gl AS (SELECT 'ENT_' || canonical_name AS id, arg_min({'l': entity_type}, global_id).l AS label FROM global_entities WHERE canonical_name IS NOT NULL GROUP BY 1), nd AS (SELECT id, CASE WHEN starts_with(id, 'ENT_') THEN 'Entity' WHEN starts_with(id, 'LOC_') THEN 'Location' ELSE 'Event' END AS type, replace(regexp_replace(id, '^[A-Z]+_', ''), '_', ' ') AS text, label FROM (SELECT source_id AS id FROM graph_edges WHERE source_id IS NOT NULL UNION SELECT target_id FROM graph_edges WHERE target_id IS NOT NULL) LEFT JOIN gl USING (id))"


def _ranks(spark, sf):
    return graph.pagerank(table(spark, sf, "graph_edges"), iterations=5)


def _nodes(spark, sf):
    e, g = table(spark, sf, "graph_edges"), table(spark, sf, "global_entities").where("canonical_name is not null")
    labels = g.select(F.concat(F.lit("ENT_"), "canonical_name").alias("id"), "entity_type", "global_id").groupBy("id").agg(F.min_by("entity_type", "global_id").alias("label"))
    ids = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).where("id is not null").distinct()
    kind = F.when(F.col("id").startswith("ENT_"), "Entity").when(F.col("id").startswith("LOC_"), "Location").otherwise("Event")
    return ids.join(labels, "id", "left").select("id", kind.alias("type"), F.replace(F.regexp_replace("id", "^[A-Z]+_", ""), F.lit("_"), F.lit(" ")).alias("text"), "label")


@query("l5_ranked", f"WITH {_PR}, {_NODES} SELECT id, round(score * (SELECT n FROM st), 6) AS score, is_significant, coalesce(text, 'Unknown') AS text, coalesce(label, 'Unknown') AS label FROM rk LEFT JOIN nd USING (id)")
def l5(spark, sf):
    s = _ranks(spark, sf)
    r = graph.ranked(s, _nodes(spark, sf)).crossJoin(F.broadcast(s.agg(F.count("*").alias("n"))))  # one row
    return r.select("id", F.round(F.col("score") * F.col("n"), 6).alias("score"), "is_significant", "text", "label")


@query("l6_view", f"WITH {_PR}, {_NODES} SELECT id, type, label, text FROM nd JOIN rk USING (id) WHERE type IN ('Entity', 'Location') AND label IN ('PERSON', 'ORG') AND is_significant AND score >= 1e-9 ORDER BY round(score, 15) DESC, id LIMIT 25")
def l6(spark, sf):
    s = _ranks(spark, sf).withColumn("score", F.round("score", 15))
    return graph.view(s, _nodes(spark, sf), table(spark, sf, "graph_edges"), types=["Entity", "Location"], labels=["PERSON", "ORG"], significant=True, min_score=1e-9, top=25).select("id", "type", "label", "text")


@query("l6_around", f"WITH {_NODES}, nb AS (SELECT 'LOC_command_post' AS id UNION SELECT source_id FROM graph_edges WHERE target_id = 'LOC_command_post' UNION SELECT target_id FROM graph_edges WHERE source_id = 'LOC_command_post') SELECT id, type, label, text FROM nd WHERE id IN (SELECT id FROM nb)")
def l6b(spark, sf):
    e = table(spark, sf, "graph_edges")
    return graph.view(graph.degree_centrality(e), _nodes(spark, sf), e, around="LOC_command_post").select("id", "type", "label", "text")


@query("l7_induced", f"WITH {_PR}, s AS (SELECT id FROM rk WHERE is_significant) SELECT edge_id FROM graph_edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)")
def l7(spark, sf):
    return graph.induced(table(spark, sf, "graph_edges"), graph.ranked(_ranks(spark, sf)).where("is_significant")).select("edge_id")


@query("l8_neighbourhood", "SELECT DISTINCT * FROM (SELECT target_id AS id, 'out' AS direction FROM graph_edges WHERE source_id = 'LOC_command_post' UNION ALL SELECT source_id, 'in' FROM graph_edges WHERE target_id = 'LOC_command_post') WHERE id IS NOT NULL")
def l8(spark, sf):
    nodes = _nodes(spark, sf).withColumn("ord", F.col("id"))
    return graph.neighbourhood(table(spark, sf, "graph_edges"), graph.find_node(nodes.where("type = 'Location'"), "Command Post"))


@query("m2_edge_dedupe", "SELECT source_id, target_id, edge_type, min(edge_id) AS edge_id, arg_min(case_id, edge_id) AS case_id FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND edge_type IS NOT NULL GROUP BY source_id, target_id, edge_type")
def m2(spark, sf):
    return graph.dedupe_edges(table(spark, sf, "graph_edges")).select("source_id", "target_id", "edge_type", "edge_id", "case_id")


@query("m3_chunks", "SELECT chunk, count(*) AS n, min(edge_id) AS first_id FROM (SELECT edge_id, ((row_number() OVER (ORDER BY edge_id) - 1) // 100)::BIGINT AS chunk FROM graph_edges) GROUP BY chunk")
def m3(spark, sf):
    return graph.chunks(table(spark, sf, "graph_edges"), "edge_id").groupBy("chunk").agg(F.count("*").alias("n"), F.min("edge_id").alias("first_id"))


# --- quality ----------------------------------------------------------------------------------------------------
@query("n4_verify_cases", """WITH e AS (SELECT case_id, count(*) AS n_entities, count(*) FILTER (entity_name IS NULL) AS bad_entities FROM entities GROUP BY 1), r AS (SELECT case_id, count(*) AS n_relations, count(*) FILTER (subject_text IS NULL OR object_text IS NULL) AS bad_relations FROM edges_relations GROUP BY 1),
    v AS (SELECT case_id, count(*) AS n_events, count(*) FILTER (event_id IS NULL) AS bad_events FROM case_events GROUP BY 1), j AS (SELECT case_id, coalesce(n_entities, 0) AS n_entities, coalesce(bad_entities, 0) AS bad_entities, coalesce(n_relations, 0) AS n_relations, coalesce(bad_relations, 0) AS bad_relations, coalesce(n_events, 0) AS n_events, coalesce(bad_events, 0) AS bad_events FROM e FULL JOIN r USING (case_id) FULL JOIN v USING (case_id))
    SELECT *, n_entities > 0 AND n_relations >= 5 AND n_events > 0 AND bad_entities + bad_relations + bad_events = 0 AS passed FROM j""")
def n4(spark, sf):
    return quality.verify(table(spark, sf, "entities"), table(spark, sf, "edges_relations"), table(spark, sf, "case_events"))


@query("n3_malformed", "SELECT 'entity' AS kind, id AS row_id, 'entity without text' AS message FROM entities WHERE entity_name IS NULL UNION ALL SELECT 'relation', rel_id, 'relation without subject or object' FROM edges_relations WHERE subject_text IS NULL OR object_text IS NULL UNION ALL SELECT 'event', id, 'event without id' FROM case_events WHERE event_id IS NULL")
def n3(spark, sf):
    return quality.malformed(table(spark, sf, "entities"), table(spark, sf, "edges_relations"), table(spark, sf, "case_events"))


@query("n5_edge_types", "WITH h AS (SELECT edge_type AS value, count(*) AS n FROM graph_edges GROUP BY 1) SELECT 'type' AS part, value, n FROM h UNION ALL SELECT 'total', NULL, sum(n) FROM h UNION ALL SELECT 'types', NULL, count(*) FROM h UNION ALL (SELECT 'top', value, n FROM h ORDER BY n DESC, value NULLS FIRST LIMIT 10)")
def n5(spark, sf):
    return quality.categories(table(spark, sf, "graph_edges"), "edge_type")


@query("n8_sample_entities", "SELECT id, entity_name, entity_type FROM entities ORDER BY id LIMIT 20")
def n8(spark, sf):
    return quality.first_rows(table(spark, sf, "entities"), "id", 20).select("id", "entity_name", "entity_type")


@query("n6_entity_types", "SELECT entity_type AS value, count(*) AS n FROM entities GROUP BY 1")
def n6(spark, sf):
    return quality.histogram(table(spark, sf, "entities"), "entity_type")


@query("n7_top_nodes", f"WITH {_PR}, {_NODES} SELECT id, coalesce(text, 'Unknown') AS text FROM rk LEFT JOIN nd USING (id) ORDER BY round(score, 15) DESC, id LIMIT 10")
def n7(spark, sf):
    return graph.ranked(_ranks(spark, sf), _nodes(spark, sf)).orderBy(F.desc(F.round("score", 15)), "id").limit(10).select("id", "text")


@query("r1_orphans", "SELECT 'entities.global_id' AS key, count(*) AS n FROM entities WHERE global_id IS NOT NULL AND global_id NOT IN (SELECT global_id FROM global_entities) UNION ALL SELECT 'edges_relations.subject_id', count(*) FROM edges_relations WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'edges_relations.object_id', count(*) FROM edges_relations WHERE object_id IS NOT NULL AND object_id NOT IN (SELECT id FROM entities)")
def r1(spark, sf):
    e, g, r = table(spark, sf, "entities"), table(spark, sf, "global_entities"), table(spark, sf, "edges_relations")
    n = lambda name, df: df.agg(F.lit(name).alias("key"), F.count("*").alias("n"))
    return n("entities.global_id", quality.orphans(e, "global_id", g, "global_id")).unionByName(n("edges_relations.subject_id", quality.orphans(r, "subject_id", e, "id"))).unionByName(n("edges_relations.object_id", quality.orphans(r, "object_id", e, "id")))


# --- web --------------------------------------------------------------------------------------------------------
_PAGES = f"""pg AS (SELECT doc_id AS page_id, source AS site, coalesce(list_filter(list_transform(string_split(regexp_replace(text, '(?m)^#+ *', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 'Untitled page') AS title, text, ({SQL_WORDS})::BIGINT AS word_count, {SQL_TOKENS} AS token_estimate, regexp_extract_all(text, '\\[([^\\]\\n]+)\\]', 1) AS labels FROM documents WHERE doc_type = 'webpage' AND source IS NOT NULL)"""
_KW = rf"""w AS (SELECT site, page_id, unnest(range(0, len(ws))) AS pos, ws FROM (SELECT site, page_id, string_split({sql_squeeze('text')}, ' ') AS ws FROM pg)), x AS (SELECT site, page_id, pos, ws[pos + 1] AS t FROM w), k AS (SELECT site, lower(t) AS word, count(*) AS n, min(page_id * 1000000 + pos) AS f FROM x WHERE regexp_matches(t, '^\p{{L}}+$') AND length(t) > 3 GROUP BY ALL), kw AS (SELECT site, word, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS rank FROM k)"""


@query("o5_keywords", f"WITH {_PAGES}, {_KW} SELECT site, word, n, rank FROM kw WHERE rank <= 12")
def o5(spark, sf):
    return web.keywords(web.pages(table(spark, sf, "documents")))


@query("o7_site_tokens", f"WITH {_PAGES} SELECT site, count(*) AS pages, sum(token_estimate)::BIGINT AS tokens FROM pg GROUP BY site")
def o7(spark, sf):
    return web.pages(table(spark, sf, "documents")).groupBy("site").agg(F.count("*").alias("pages"), F.sum("token_estimate").alias("tokens"))


@query("o8_token_budget", f"WITH {_PAGES}, u AS (SELECT site, page_id, token_estimate AS t, coalesce(sum(token_estimate) OVER (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM pg) SELECT site, page_id, least(t, 4000 - used)::BIGINT AS allowance FROM u WHERE least(t, 4000 - used) > 0")
def o8(spark, sf):
    return web.budgeted(web.pages(table(spark, sf, "documents")), 4000)


@query("q1_prompts", rf"""WITH {_PAGES} SELECT page_id, 'Summarise this page.' || chr(10) || 'Title: ' || title || chr(10) || 'URL: https://' || replace(site, '_', '-') || '.example/' || page_id || chr(10) || chr(10) ||
    CASE WHEN token_estimate <= 200 THEN {sql_squeeze('text')} ELSE array_to_string(string_split({sql_squeeze('text')}, ' ')[1:greatest(1, floor(200.0 / token_estimate * word_count))::INT], ' ') || '...' END AS prompt FROM pg""")
def q1(spark, sf):
    p = web.pages(table(spark, sf, "documents"))
    return p.select("page_id", web.prompt(p).alias("prompt"))


@query("s1_event_timeline", "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def s1(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("m1_positions", "SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS pos FROM entities")
def m1(spark, sf):
    return position(table(spark, sf, "entities"), ["case_id"], F.floor(F.col("id") / 1000), ["id"], "pos").select("case_id", "id", "pos")


# --- assemblies -------------------------------------------------------------------------------------------------
@query("b16_safe_names", "SELECT doc_id, regexp_replace(substring(title, 1, 30), '[^A-Za-z0-9]+', '-', 'g') AS file FROM documents WHERE title IS NOT NULL")
def b16(spark, sf):
    return table(spark, sf, "documents").where("title is not null").select("doc_id", F.regexp_replace(F.substring("title", 1, 30), "[^A-Za-z0-9]+", "-").alias("file"))


_KEYS = [*fixed.SECTION_TITLES, "other_section", "plain"]


@query("b17_section_titles", f"SELECT k AS key, CASE k {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in fixed.SECTION_TITLES.items())} ELSE array_to_string(list_transform(string_split(k, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title FROM (SELECT unnest({_KEYS}) AS k)")
def b17(spark, sf):
    return spark.createDataFrame([(k,) for k in _KEYS], "key string").select("key", text.section_title(F.col("key")).alias("title"))


@query("f7_case_pool", f"WITH m AS (SELECT case_id, {SQL_COREF.format('x')} AS norm, x AS mention, o FROM (SELECT case_id, unnest(mentions) AS x, global_id AS o FROM global_entities)) SELECT case_id, norm, count(DISTINCT mention) AS n_mentions, min(o) AS first_id FROM m WHERE norm <> '' GROUP BY ALL")
def f7(spark, sf):
    g = table(spark, sf, "global_entities").select("case_id", F.explode("mentions").alias("mention"), F.col("global_id").alias("ord"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("label"), F.lit("").alias("source"))
    p = ent.pool(g.withColumn("norm", text.coref_norm(F.col("mention"))).where("norm != ''"), ["case_id"])
    first = g.withColumn("norm", text.coref_norm(F.col("mention"))).groupBy("case_id", "norm").agg(F.min("ord").alias("first_id"))
    return p.join(first, ["case_id", "norm"]).select("case_id", "norm", F.size("mentions").cast("bigint").alias("n_mentions"), "first_id")


@query("k2_event_nodes", "SELECT event_id, min(id) AS first_row, arg_min(coalesce(description, ''), id) AS description FROM case_events WHERE event_id IS NOT NULL GROUP BY event_id")
def k2(spark, sf):
    e = table(spark, sf, "case_events").where("event_id is not null").select("event_id", F.col("id").alias("first_row"), F.coalesce("description", F.lit("")).alias("description"))
    return graph.first_by(e, ["event_id"], "first_row", ["first_row", "description"])


@query("m1_node_dedupe", f"SELECT id, arg_min(text, ord) AS text, arg_min(label, ord) AS label FROM (SELECT 'ENT_' || replace(lower({sql_squeeze('entity_name')}), ' ', '_') AS id, entity_name AS text, coalesce(entity_type, 'Unknown') AS label, id AS ord FROM entities WHERE trim(entity_name) <> '') GROUP BY id")
def m1n(spark, sf):
    n = table(spark, sf, "entities").where("trim(entity_name) != ''").select(text.entity_id(F.col("entity_name")).alias("id"), F.col("entity_name").alias("text"), F.col("entity_type").alias("label"), F.col("id").alias("ord"))
    return graph.dedupe_nodes(n).select("id", "text", "label")


@query("k10_nodes_by_type", f"""WITH p AS (SELECT 'Entity' AS type, 'ENT_' || replace(lower({sql_squeeze('entity_name')}), ' ', '_') AS id FROM entities WHERE trim(entity_name) <> '' UNION ALL SELECT 'Event', event_id FROM case_events WHERE event_id IS NOT NULL
    UNION ALL SELECT 'Location', 'LOC_' || replace(lower({sql_squeeze('location')}), ' ', '_') FROM {_LOC} UNION ALL SELECT 'Time', 'TIME_' || regexp_replace(iso, '[:T-]', '', 'g') FROM {_ISO.replace('PAT', f'{chr(39)}{_LENIENT}{chr(39)}')} WHERE iso IS NOT NULL) SELECT type, count(DISTINCT id) AS n FROM p GROUP BY type""")
def k10(spark, sf):
    events = table(spark, sf, "case_events")
    e = table(spark, sf, "entities").where("trim(entity_name) != ''").select(F.lit("Entity").alias("type"), text.entity_id(F.col("entity_name")).alias("id"))
    v = events.where("event_id is not null").select(F.lit("Event").alias("type"), F.col("event_id").alias("id"))
    loc = ev.locations(events, table(spark, sf, "entities")).select(F.lit("Location").alias("type"), text.entity_id(F.col("location"), "LOC_").alias("id"))
    t = _timed(spark, sf).where("time_resolved is not null").select(F.lit("Time").alias("type"), text.time_id(F.col("time_resolved")).alias("id"))
    return e.unionByName(v).unionByName(loc).unionByName(t).distinct().groupBy("type").agg(F.count("*").alias("n"))


@query("n9_report", f"""WITH {_PR}, {_NODES} SELECT 'graph_statistics' AS section, 'total_nodes' AS key, count(*)::DOUBLE AS value FROM nd UNION ALL SELECT 'graph_statistics', 'total_edges', count(*) FROM graph_edges UNION ALL SELECT 'node_types', type, count(*) FROM nd GROUP BY ALL UNION ALL SELECT 'entity_labels', coalesce(label, 'unknown'), count(*) FROM nd WHERE type = 'Entity' GROUP BY ALL
    UNION ALL SELECT 'pagerank', 'significant_nodes', count(*) FROM rk WHERE is_significant UNION ALL SELECT 'pagerank', k, round(v * n, 4) FROM (SELECT unnest(['min', 'max', 'mean', 'median']) AS k, unnest([min(score), max(score), avg(score), median(score)]) AS v, count(*) AS n FROM sc)
    UNION ALL SELECT 'relation_analysis', 'total_relations', count(*) FROM graph_edges UNION ALL SELECT 'relation_analysis', 'unique_relation_types', count(DISTINCT coalesce(edge_type, 'unknown')) FROM graph_edges UNION ALL SELECT 'case_information', 'documents', count(*) FROM documents""")
def n9(spark, sf):
    return quality.report(_nodes(spark, sf), table(spark, sf, "graph_edges"), _ranks(spark, sf), table(spark, sf, "documents"))


@query("b3_tight_abbreviations", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bR/O\b', 'Reporting Officer', 'g'), '\bR/Os\b', 'Reporting Officers', 'g'), '\bR/I\b', 'Reporting Investigator', 'g'), '\bR/Is\b', 'Reporting Investigators', 'g'), '\bCSU\b', 'Crime Scene Unit', 'g'), '\bETA\b', 'Estimated Time of Arrival', 'g') AS expanded FROM documents WHERE text IS NOT NULL")
def b3(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.expand_tight(F.col("text")).alias("expanded"))


@query("l2_eigenvector")
def l2e(spark, sf):
    return graph.eigenvector(table(spark, sf, "graph_edges"))
