"""Pages, crawl analytics, summaries without a model, and the crawl frontier."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions import fixed, text
from inkgraph.operators.ordered import running

SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
PARSED = "title string, description string, headings array<string>, links array<string>, body string"


def squeezed(s: str) -> str:
    """A text with its runs of spaces and line ends as one space each, as the column function has it."""
    return SPACES.sub(" ", s).strip(" ")


# --- pages ------------------------------------------------------------------------------------------------------
class PageParser(HTMLParser):
    """Title, description, headings of three levels, links and the text of a page."""

    SKIPPED = frozenset(("script", "style", "template", "noscript", "head"))

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.description = url, "", ""
        self.headings: list[str] = []
        self.links: list[str] = []
        self.body: list[str] = []
        self._heading: list[str] | None = None
        self._in_title, self._skip = False, 0

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if tag == "title":
            self._in_title = not self.title
        elif tag == "meta" and (got.get("name") or "").lower() == "description" and not self.description:
            self.description = squeezed(got.get("content") or "")
        elif tag in ("h1", "h2", "h3"):
            self._heading = []
        elif tag == "a" and (link := normal_link(got.get("href"), self.url)):
            self.links.append(link)
        if tag in self.SKIPPED:
            self._skip += 1

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        elif tag in ("h1", "h2", "h3") and self._heading is not None:
            if line := squeezed(" ".join(self._heading)):
                self.headings.append(line)
            self._heading = None
        if tag in self.SKIPPED and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if self._in_title:
            self.title = squeezed(f"{self.title} {data}")
            return
        if self._heading is not None:
            self._heading.append(data.strip())
        if not self._skip:
            self.body.append(data)


def normal_link(href: str | None, base: str) -> str | None:
    """A link joined to its page, without its fragment; None for scripts, other schemes and what is no address."""
    if not href or href.startswith("javascript:"):
        return None
    try:
        link = urljoin(base, href)
        return link.split("#")[0] if urlparse(link).scheme in ("http", "https") else None
    except ValueError:
        return None


def parse_html(html: Column | str, url: Column | str) -> Column:
    """(title, description, headings, links, body) of pages; broken markup is read as far as it goes, null gives empty fields."""

    @F.pandas_udf(PARSED)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = []
        for h, u in zip(html, url, strict=True):
            p = PageParser(u or "")
            p.feed(h or "")
            p.close()
            rows.append((p.title, p.description, p.headings[:30], p.links, squeezed(" ".join(p.body))))
        return pd.DataFrame(rows, columns=["title", "description", "headings", "links", "body"])

    return run(html, url)


def snapshots(raw: DataFrame) -> DataFrame:
    """(site, page_id, url, status, title, description, headings, links, text, word_count, token_estimate) of rows (site, page_id, url, status, html)."""
    p = raw.withColumn("p", parse_html("html", "url")).select("site", "page_id", "url", "status", "p.*")
    c = F.col("body")
    return p.select("site", "page_id", "url", "status", "title", "description", "headings", "links", c.alias("text"), text.word_count(c).cast("bigint").alias("word_count"), text.token_estimate(c).alias("token_estimate"))


def as_html(documents: DataFrame) -> DataFrame:
    """(site, page_id, url, status, html) of the web pages among the documents, whose texts are written as markup.

    A first line is the heading and title, the paragraph after it the description, words in brackets are links.
    """
    d = documents.where((F.col("doc_type") == "webpage") & F.col("source").isNotNull() & F.col("text").isNotNull())
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "(?m)^#+ *", ""), "\n"), lambda x: text.squeeze(x)), lambda x: x != "")
    d = d.select("doc_id", "source", "text", lines.alias("lines")).withColumn("site", F.concat(F.lit("https://"), F.replace("source", F.lit("_"), F.lit("-")), F.lit(".example")))
    labels = F.regexp_extract_all("text", F.lit(r"\[([^\]\n]+)\]"), F.lit(1))
    links = F.array_join(F.transform(labels, lambda x: F.concat(F.lit('<a href="'), F.regexp_replace(F.lower(x), "[^a-z]+", "-"), F.lit('">'), safe(x), F.lit("</a>"))), "\n")
    more = F.concat(F.lit('<a href="../about#us">About</a> <a href="//cdn.example/x.js">x</a> <a href="javascript:void(0)">y</a> <a href="https://other.example/'), F.col("doc_id").cast("string"), F.lit('">z</a>'))
    title = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    html = F.concat(F.lit("<html><head><title>"), safe(title), F.lit('</title><meta name="description" content="'), safe(F.coalesce(F.get("lines", F.lit(1)), F.lit(""))), F.lit('"></head><body><h1>'), safe(title), F.lit("</h1><p>"), safe(F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), "\n")), F.lit("</p>\n"), links, F.lit("\n"), more, F.lit("</body></html>"))
    return d.select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), F.concat("site", F.lit("/pages/"), F.col("doc_id").cast("string")).alias("url"), F.lit("200").alias("status"), html.alias("html"))


def pages(documents: DataFrame) -> DataFrame:
    """Web pages among the documents as they stand: page_id, site, url, title, headings, labels in brackets, word count and token estimate."""
    d = documents.where((F.col("doc_type") == "webpage") & F.col("source").isNotNull())
    lines = F.split("text", "\n")
    heads = F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    return d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), F.concat(F.lit("https://"), F.replace("source", F.lit("_"), F.lit("-")), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
                    F.coalesce(text.first_line(F.regexp_replace("text", "(?m)^#+ *", "")), F.lit("Untitled page")).alias("title"), heads.alias("headings"), F.regexp_extract_all("text", F.lit(r"\[([^\]\n]+)\]"), F.lit(1)).alias("labels"),
                    "text", text.word_count(F.col("text")).cast("bigint").alias("word_count"), text.token_estimate(F.col("text")).alias("token_estimate"))


# --- analysis ---------------------------------------------------------------------------------------------------
def keywords(p: DataFrame, top: int = 12) -> DataFrame:
    """(site, word, n, rank): the most frequent plain words, ties by first occurrence (a top-k report)."""
    words = p.select("site", "page_id", F.posexplode(F.split(text.squeeze(F.col("text")), " ")).alias("pos", "w"))
    words = words.where(F.col("w").rlike(r"^\p{L}+$") & (F.length("w") > 3)).withColumn("word", F.lower("w"))
    n = words.groupBy("site", "word").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "pos")).alias("first_at"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "first_at"))
    return n.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select("site", "word", "n", "rank")


def calls_to_action(p: DataFrame) -> DataFrame:
    """(site, link, n): links that hold a word that calls to act."""
    links = p.select("site", F.explode("links").alias("link"))
    return links.where(F.lower("link").rlike(fixed.CALLS_TO_ACTION)).groupBy("site", "link").agg(F.count("*").alias("n"))


def link_kinds(p: DataFrame) -> DataFrame:
    """(site, page_id, link, internal): occurrences of links; internal ones have the authority of their page."""
    links = p.select("site", "page_id", F.parse_url("url", F.lit("AUTHORITY")).alias("_own"), F.explode("links").alias("link"))
    return links.select("site", "page_id", "link", (F.try_parse_url("link", F.lit("AUTHORITY")).eqNullSafe(F.col("_own"))).alias("internal"))


def analysis(p: DataFrame) -> DataFrame:
    """One row per site: pages, link occurrences by kind, tokens, first headings, most frequent words, sorted calls to action.

    Each part is aggregated by itself before the parts are joined; only top lists leave the aggregates of words and headings.
    """
    base = p.groupBy("site").agg(F.count("*").alias("total_pages"), F.sum("token_estimate").alias("total_tokens"))
    kinds = link_kinds(p).groupBy("site").agg(F.count_if("internal").alias("internal_links"), F.count_if(~F.col("internal")).alias("external_links"))
    heads = p.select("site", "page_id", F.posexplode("headings").alias("pos", "h"))
    w = Window.partitionBy("site").orderBy("page_id", "pos")
    first = p.where(F.size("headings") > 0).select("site", "page_id").withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).where("_k <= 10")  # ten headings lie on at most ten pages
    heads = heads.join(first.drop("_k"), ["site", "page_id"], "left_semi").withColumn("k", F.row_number().over(w)).where("k <= 10")
    listed = lambda df, order, value, out: df.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(out))
    ctas = calls_to_action(p).groupBy("site").agg(F.array_sort(F.collect_set("link")).alias("ctas"))
    out = base.join(kinds, "site", "left").join(listed(heads, "k", "h", "top_headings"), "site", "left").join(listed(keywords(p), "rank", "word", "keywords"), "site", "left").join(ctas, "site", "left")
    none = F.array().cast("array<string>")
    return out.fillna(0).withColumns({c: F.coalesce(c, none) for c in ("top_headings", "keywords", "ctas")})


def page_summaries(p: DataFrame) -> DataFrame:
    """(site, page_id, url, title, description, headings, word_count, status): what a summary says of each page."""
    return p.select("site", "page_id", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled page")).alias("title"), "description", F.slice("headings", 1, 5).alias("headings"), "word_count", "status")


def budgeted(p: DataFrame, budget: int) -> DataFrame:
    """(site, page_id, allowance): what is left of a token budget for each page in order, pages without any left out."""
    r = running(p, ["site"], F.floor(F.col("page_id") / 1000), ["page_id"], F.col("token_estimate"), "used")
    return r.withColumn("allowance", F.least(F.col("token_estimate"), F.lit(budget) - F.col("used"))).where("allowance > 0").select("site", "page_id", "allowance")


def aggregate_text(p: DataFrame, budget: int) -> DataFrame:
    """(site, page_id, chunk): the text of each page within the budget, cut to what is left, under its address."""
    b = budgeted(p, budget).join(p.select("site", "page_id", "url", "text", "token_estimate", "word_count"), ["site", "page_id"])
    words = F.split(F.col("text"), " ")
    keep = F.greatest(F.lit(1), F.floor(F.col("allowance") / F.col("token_estimate") * F.col("word_count"))).cast("int")
    kept = F.when(F.col("token_estimate") <= F.col("allowance"), F.col("text")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), keep), " "), F.lit("...")))
    return b.select("site", "page_id", F.concat(F.lit("URL: "), "url", F.lit("\n"), kept).alias("chunk"))


# --- summaries --------------------------------------------------------------------------------------------------
def site_summary(p: DataFrame, reason: str) -> DataFrame:
    """(site, section, idx, line): a summary of snapshots from the crawl alone."""
    a = analysis(p)
    top = page_summaries(p).withColumn("idx", F.row_number().over(Window.partitionBy("site").orderBy("page_id")).cast("bigint")).where("idx <= 3")
    snippet = F.coalesce(F.nullif("description", F.lit("")), F.nullif(F.array_join("headings", " / "), F.lit("")), F.concat(F.col("word_count").cast("string"), F.lit(" words (status "), "status", F.lit(")")))
    sections = top.select("site", F.lit("key_sections").alias("section"), "idx", F.concat("title", F.lit(": "), snippet).alias("line"))
    count = lambda c: F.col(c).cast("string")
    lines = F.array_compact(F.array(F.when(F.size("keywords") > 0, F.concat(F.lit("Top keywords: "), F.array_join(F.slice("keywords", 1, 6), ", "))), F.concat(F.lit("Internal links: "), count("internal_links"), F.lit(" · External links: "), count("external_links")), F.when(F.size("ctas") > 0, F.concat(F.lit("Detected CTAs: "), F.array_join(F.slice("ctas", 1, 5), ", ")))))
    listed = lambda name, arr: a.select("site", F.lit(name).alias("section"), F.posexplode(arr).alias("i", "line")).select("site", "section", (F.col("i") + 1).cast("bigint").alias("idx"), "line")
    over = fixed.OVERVIEW.replace("{reason}", reason).split("{pages}")
    before, after = over[0], over[1].split("{root}")
    overview = F.array(F.concat(F.lit(before), count("total_pages"), F.lit(after[0]), "site", F.lit(after[1])))
    return listed("overview", overview).unionByName(sections).unionByName(listed("highlights", lines)).unionByName(listed("recommendations", F.array(*map(F.lit, fixed.RECOMMENDATIONS))))


def text_summary(size: Column, reason: Column) -> Column:
    """(overview, content_type, sections) of a text that no model summed up."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{size}"), size.cast("string")), F.lit("{reason}"), reason)
    sections = F.create_map(*[x for k, v in fixed.TEXT_SECTIONS.items() for x in (F.lit(k), F.array(fill(v)))])
    return F.struct(fill(fixed.TEXT_OVERVIEW).alias("overview"), F.lit("document").alias("content_type"), sections.alias("sections"))


SITE_REQUEST = 'Write a short briefing on this site from the data and the text below. Answer in JSON only: {"overview": text, "content_type": "website", "sections": {"key_sections": [], "highlights": [], "recommendations": []}}'
TEXT_REQUEST = 'Say what kind of text this is and sum it up in three to six sections that suit its kind. Answer in JSON only: {"overview": text, "content_type": kind, "sections": {name: [lines]}}'


def site_prompts(p: DataFrame, budget: int) -> DataFrame:
    """(site, prompt): the request for a site, with its metadata as JSON and its text within a token budget."""
    pg = page_summaries(p).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url", "title", "description", "headings", "word_count", "status"))), lambda x: x.dropFields("page_id")).alias("pages"))
    chunks = aggregate_text(p, budget).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("context"))  # within the budget
    a = analysis(p).join(pg, "site").join(chunks, "site", "left")
    meta = F.to_json(F.struct(F.col("site").alias("root_url"), "pages", "keywords", F.col("ctas").alias("cta_links")))
    return a.select("site", F.concat(F.lit(SITE_REQUEST + "\nMetadata: "), meta, F.lit("\nContent:\n"), F.coalesce("context", F.lit(""))).alias("prompt"))


def text_prompt(body: Column) -> Column:
    return F.concat(F.lit(TEXT_REQUEST + "\nContent:\n"), body)


def prompt(p: DataFrame) -> Column:
    """The request to a summarising model for one page."""
    return F.concat(F.lit("Summarise this page.\nTitle: "), "title", F.lit("\nURL: "), "url", F.lit("\n\n"), text.within_budget(F.col("text"), 200))


# --- crawl ------------------------------------------------------------------------------------------------------
def frontier(links: DataFrame, root: str, most: int = 3, loaded: DataFrame | None = None) -> DataFrame:
    """(visit, url): the first ``most`` pages of a breadth-first crawl over link occurrences (src, pos, dst).

    The queue is first in, first out; internal links that were not visited are added while it is shorter than three times
    ``most``, repeats included; pages that are not ``loaded`` (url) do not count.  ``most`` bounds what comes to the driver: per
    round the first 3 x ``most`` unseen internal links of the pages in the queue.
    """
    spark = links.sparkSession
    root = root.rstrip("/")
    host = urlparse(root).netloc
    inside = links.where(F.try_parse_url("dst", F.lit("AUTHORITY")).eqNullSafe(F.lit(host))) if host else links
    queue, seen, visits, known, good = [root], set(), [], {}, {}
    while queue and len(visits) < most:
        ask = [u for u in dict.fromkeys(queue) if u not in known]
        if ask:
            w = Window.partitionBy("src").orderBy("pos", "dst")
            rows = inside.where(F.col("src").isin(ask) & ~F.col("dst").isin(sorted(seen | {root}))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= 3 * most).collect()
            ok = set(ask) if loaded is None else {r.url for r in loaded.where(F.col("url").isin(ask)).select("url").distinct().collect()}
            for u in ask:
                known[u] = [r.dst for r in sorted((r for r in rows if r.src == u), key=lambda r: r.k)]
                good[u] = u in ok
        while queue and len(visits) < most and queue[0] in known:
            u = queue.pop(0)
            if u in seen:
                continue
            seen.add(u)
            if not good[u]:
                continue
            visits.append(u)
            for link in known[u]:
                if link not in seen and len(queue) < 3 * most:
                    queue.append(link)
    return spark.createDataFrame(list(enumerate(visits)), "visit bigint, url string")
