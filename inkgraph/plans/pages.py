"""Queries of pages, crawl analytics and summaries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgraph.operators import web
from inkgraph.plans.core import SQL_TOKENS, SQL_WORDS, query, sql_squeeze
from inkgraph.sources.tables import table

_LINES = "list_filter(list_transform(string_split(regexp_replace(text, '(?m)^#+ *', '', 'g'), chr(10)), lambda x: {0}), lambda x: x <> '')".format(sql_squeeze("x"))
_SNAP = rf"""d0 AS (SELECT doc_id, source, 'https://' || replace(source, '_', '-') || '.example' AS base, {_LINES} AS lines, regexp_extract_all(text, '\[([^\]\n]+)\]', 1) AS labels FROM documents WHERE doc_type = 'webpage' AND source IS NOT NULL AND text IS NOT NULL),
    d1 AS (SELECT doc_id AS page_id, source AS site, base, base || '/pages/' || doc_id AS url, coalesce(lines[1], '') AS title, coalesce(lines[2], '') AS description, {sql_squeeze("array_to_string(list_concat([coalesce(lines[1], '')], lines[2:], labels, ['About x y z']), ' ')")} AS text,
      list_concat(list_transform(labels, lambda x: base || '/pages/' || regexp_replace(lower(x), '[^a-z]+', '-', 'g')), [base || '/about', 'https://cdn.example/x.js', 'https://other.example/' || doc_id]) AS links FROM d0),
    sn AS (SELECT *, ({SQL_WORDS})::BIGINT AS word_count, {SQL_TOKENS} AS token_estimate FROM d1)"""
_WORDS = r"""w0 AS (SELECT site, page_id, unnest(range(0, len(ws))) AS pos, ws FROM (SELECT site, page_id, string_split(text, ' ') AS ws FROM sn)), w1 AS (SELECT site, page_id, pos, ws[pos + 1] AS t FROM w0),
    k0 AS (SELECT site, lower(t) AS word, count(*) AS n, min([page_id, pos]) AS f FROM w1 WHERE regexp_matches(t, '^\p{L}+$') AND length(t) > 3 GROUP BY ALL), kw AS (SELECT site, word, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, f) AS rank FROM k0)"""
_ANALYSIS = """lk AS (SELECT site, page_id, base, unnest(links) AS link FROM sn), lc AS (SELECT site, count(*) FILTER (starts_with(link, base || '/')) AS internal_links, count(*) FILTER (NOT starts_with(link, base || '/')) AS external_links FROM lk GROUP BY site),
    ct AS (SELECT DISTINCT site, link FROM lk WHERE regexp_matches(lower(link), 'contact|buy|get|demo|signup|book|start|quote')), ca AS (SELECT site, list_sort(list(link)) AS ctas FROM ct GROUP BY site),
    hd AS (SELECT site, title, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM sn WHERE title <> ''), ha AS (SELECT site, string_agg(title, '|' ORDER BY k) AS heads FROM hd WHERE k <= 10 GROUP BY site),
    an AS (SELECT site, count(*) AS total_pages, sum(token_estimate)::BIGINT AS total_tokens FROM sn GROUP BY site), ka AS (SELECT site, list(word ORDER BY rank) AS words FROM kw WHERE rank <= 12 GROUP BY site)"""


def _snaps(spark, sf):
    return web.snapshots(web.as_html(table(spark, sf, "documents")))


@query("o2_page_snapshots", f"WITH {_SNAP} SELECT page_id, site, url, title, description, title AS headings, array_to_string(links, ' ') AS links, text, word_count, token_estimate FROM sn")
def o2(spark, sf):
    return _snaps(spark, sf).select("page_id", "site", "url", "title", "description", F.array_join("headings", "|").alias("headings"), F.array_join("links", " ").alias("links"), "text", "word_count", "token_estimate")


@query("o3_link_kinds", f"WITH {_SNAP} SELECT site, page_id, link, starts_with(link, base || '/') AS internal FROM (SELECT site, page_id, base, unnest(links) AS link FROM sn)")
def o3(spark, sf):
    return web.link_kinds(_snaps(spark, sf))


@query("o4_site_analysis", f"WITH {_SNAP}, {_WORDS}, {_ANALYSIS} SELECT site, total_pages, total_tokens, internal_links, external_links, coalesce(heads, '') AS top_headings, coalesce(array_to_string(words, '|'), '') AS keywords, coalesce(array_to_string(ctas, '|'), '') AS ctas FROM an LEFT JOIN lc USING (site) LEFT JOIN ha USING (site) LEFT JOIN ka USING (site) LEFT JOIN ca USING (site)")
def o4(spark, sf):
    a = web.analysis(_snaps(spark, sf))
    return a.select("site", "total_pages", "total_tokens", "internal_links", "external_links", *[F.array_join(c, "|").alias(c) for c in ("top_headings", "keywords", "ctas")])


@query("o6_calls_to_action", f"WITH {_SNAP} SELECT site, link, count(*) AS n FROM (SELECT site, unnest(links) AS link FROM sn) WHERE regexp_matches(lower(link), 'contact|buy|get|demo|signup|book|start|quote') GROUP BY ALL")
def o6(spark, sf):
    return web.calls_to_action(_snaps(spark, sf))


@query("o8_text_in_budget", f"""WITH {_SNAP}, u AS (SELECT *, coalesce(sum(token_estimate) OVER (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sn), v AS (SELECT *, least(token_estimate, 4000 - used) AS a FROM u WHERE used < 4000)
    SELECT site, page_id, 'URL: ' || url || chr(10) || CASE WHEN token_estimate <= a THEN text ELSE array_to_string(string_split(text, ' ')[1:greatest(1, floor(a::DOUBLE / token_estimate * word_count))::INT], ' ') || '...' END AS chunk FROM v WHERE a > 0""")
def o8b(spark, sf):
    return web.aggregate_text(_snaps(spark, sf), 4000)


@query("o1_frontier")
def o1(spark, sf):
    p = _snaps(spark, sf)
    links = p.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst"))
    first = p.agg(F.min("url")).first()[0] or ""
    return web.frontier(links, first, 3)


@query("q6_site_summary", f"""WITH {_SNAP}, {_WORDS}, {_ANALYSIS}, rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS idx FROM sn),
    hl AS (SELECT site, list_filter([CASE WHEN words IS NOT NULL THEN 'Top keywords: ' || array_to_string(words[1:6], ', ') END, 'Internal links: ' || coalesce(internal_links, 0) || ' · External links: ' || coalesce(external_links, 0), CASE WHEN ctas IS NOT NULL THEN 'Detected CTAs: ' || array_to_string(ctas[1:5], ', ') END], lambda x: x IS NOT NULL) AS ls FROM an LEFT JOIN lc USING (site) LEFT JOIN ka USING (site) LEFT JOIN ca USING (site))
    SELECT site, section, idx::BIGINT AS idx, line FROM (SELECT site, 'overview' AS section, 1 AS idx, 'Crawled ' || total_pages || ' page(s) from ' || site || '. LLM output unavailable (no provider); showing crawler-derived summary.' AS line FROM an
    UNION ALL SELECT site, 'key_sections', idx, CASE WHEN title = '' THEN 'Untitled page' ELSE title END || ': ' || coalesce(nullif(description, ''), nullif(title, ''), word_count || ' words (status 200)') FROM rk WHERE idx <= 3
    UNION ALL SELECT site, 'highlights', unnest(range(1, len(ls) + 1)), unnest(ls) FROM hl
    UNION ALL SELECT site, 'recommendations', unnest([1, 2]), unnest(['Review the crawler output manually because the LLM blocked the content.', 'Retry with sanitized text or a different site if you need an AI-authored summary.']) FROM an)""")
def q6(spark, sf):
    return web.site_summary(_snaps(spark, sf), "no provider")


@query("q1_site_prompts")
def q1b(spark, sf):
    return web.site_prompts(_snaps(spark, sf), 4000)


@query("q2_text_prompts", "SELECT id, '" + web.TEXT_REQUEST.replace("'", "''") + "' || chr(10) || 'Content:' || chr(10) || text AS prompt FROM narratives WHERE text IS NOT NULL")
def q2(spark, sf):
    return table(spark, sf, "narratives").where("text is not null").select("id", web.text_prompt(F.col("text")).alias("prompt"))


@query("q8_text_summaries", """SELECT id, 'Text analysis unavailable (blocked). Content length: ' || length(text) || ' characters.' AS overview, k AS section, CASE k WHEN 'error_info' THEN 'Content could not be analyzed by LLM' WHEN 'content_stats' THEN 'Text length: ' || length(text) || ' characters' ELSE 'Try with different content or check LLM configuration' END AS line
    FROM (SELECT id, text, unnest(['error_info', 'content_stats', 'suggestions']) AS k FROM narratives WHERE text IS NOT NULL)""")
def q8(spark, sf):
    s = table(spark, sf, "narratives").where("text is not null").select("id", web.text_summary(F.length("text"), F.lit("blocked")).alias("s"))
    return s.select("id", "s.overview", F.explode("s.sections").alias("section", "lines")).select("id", "overview", "section", F.get("lines", F.lit(0)).alias("line"))


@query("q10_serialised_metrics", f"WITH {_SNAP}, {_WORDS}, {_ANALYSIS} SELECT site, to_json({{'root_url': site, 'total_pages': total_pages, 'internal_links': coalesce(internal_links, 0), 'external_links': coalesce(external_links, 0)}})::VARCHAR AS payload FROM an LEFT JOIN lc USING (site)")
def q10(spark, sf):
    a = web.analysis(_snaps(spark, sf))
    return a.select("site", F.to_json(F.struct(F.col("site").alias("root_url"), "total_pages", "internal_links", "external_links")).alias("payload"))
