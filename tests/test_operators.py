"""Operators on small invented rows."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkgraph.functions import text
from inkgraph.operators import casework, entities, events, graph, parses, payloads, providers, quality, relations, segment, web
from inkgraph.operators import timestamps
from inkgraph.operators.ordered import following, position, running
from inkgraph.operators.timestamps import case_times, normalize, zone_intervals
from inkgraph.sources import files, models
from inkgraph.streaming import timeline


def one(spark, c, **row):
    return spark.createDataFrame([Row(**row)]).select(c.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.narrative(F.col("t")), t="REPORTING OFFICER’S NARRATIVE\nEPORTING at 5 º\n R/O said") == "REPORTING at 5 ° R / O said"
    assert one(spark, text.expand(F.col("t")), t="R/O and R / Os, R/Is of CSU; ETA") == "Reporting Officer and Reporting Officers, Reporting Investigators of Crime Scene Unit; Estimated Time of Arrival"
    assert one(spark, text.ner_norm(F.col("t")), t="Coroner's Inspector") == "coroner_s_inspector"
    assert one(spark, text.coref_norm(F.col("t")), t=" Coroner's  Inspector ") == "coroners_inspector"
    assert one(spark, text.word_count(F.col("t")), t="   ") == 0
    assert one(spark, text.token_estimate(F.col("t")), t="") == 1
    assert one(spark, text.within_budget(F.col("t"), 2), t="a b c d") == "a b..."
    assert one(spark, text.unfenced(F.col("t")), t="```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, text.section_title(F.col("t")), t="next_steps") == "Next Steps"
    assert one(spark, text.first_line(F.col("t")), t="\n  \n Title 10 \nrest") == "Title 10"
    base = F.lit("https://a.example")
    for href, want in [("/x", "https://a.example/x"), ("x#y", "https://a.example/x"), ("#y", None), ("javascript:1", None), ("//b.example/z", "https://b.example/z"), ("", None), ("mailto:x@y", None)]:
        assert one(spark, text.absolute_link(F.col("t"), base), t=href) == want


def test_segments_and_turns(spark):
    d = spark.createDataFrame([(1, "Before. At 9:05 a.m. Inspector Lee came. Deputy Ray left.")], "id int, t string")
    rows = [(r.seg_idx, r.time, r.text) for r in segment.segments(d, "id", "t").orderBy("seg_idx").collect()]
    assert [r[1] for r in rows] == [None, "9:05 a.m.", None, None] and rows[1][2].startswith("At 9:05")
    t = spark.createDataFrame([(1, "intro line\nParticipants:\nAnn: hello: there\nand more\nBob:\n")], "id int, t string")
    got = [(r.speaker, r.text) for r in segment.colon_turns(t, "id", "t").orderBy("turn").collect()]
    assert got == [("NARRATOR", "intro line"), ("Ann", "hello: there and more")]
    m = spark.createDataFrame([(["Yes", "He came.", "So", "it", "went on."],)], "s array<string>").select(segment.merge_fragments(F.col("s")).alias("m")).first().m
    assert m == ["Yes He came.", "So it", "went on."]
    g = segment.gazetteer(spark.createDataFrame([(1, "Reporting Officer saw a dog, a dog and a dogma")], "id int, t string"), "id", "t")
    assert {(r.phrase, r.label, r.n) for r in g.collect()} == {("Reporting Officer", "ROLE", 1), ("dog", "EVIDENCE", 2)}


def test_ordered_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), i, rnd.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    seen, used, pos = {}, {}, {}
    for k, i, v in rows:
        used[i], pos[i] = seen.get(k, (0, 0))
        s, n = seen.get(k, (0, 0))
        seen[k] = (s + v, n + 1)
    bucket = F.floor(F.col("i") / 10)
    assert {r.i: r.u for r in running(df, ["k"], bucket, ["i"], F.col("v"), "u").collect()} == used
    assert {r.i: r.p for r in position(df, ["k"], bucket, ["i"], "p").collect()} == pos
    nxt, last = {}, {}
    for k, i, _ in reversed(rows):
        nxt[i] = last.get(k)
        last[k] = i
    assert {r.i: (r.following.i if r.following else None) for r in following(df, ["k"], bucket, ["i"], ["i"]).collect()} == nxt


def test_pronouns_as_of(spark):
    rnd = random.Random(2)
    rows = []
    for doc in range(5):
        for i in range(60):
            rows.append((doc, i, rnd.choice(["he", "She", "it.", "door", "ran"]), rnd.choice([None, None, None, "Ann", "Bob"])))
    want = set()
    for doc in range(5):
        last = None
        for d, i, tok, m in rows:
            if d == doc:
                p = tok.lower().strip(".")
                if p in ("he", "she", "it") and last:
                    want.add((doc, i, p, last))
                last = m or last
    got = entities.resolve_pronouns(spark.createDataFrame(rows, "id int, idx int, token string, mention string"), "id")
    assert {tuple(r) for r in got.collect()} == want


def test_pool_and_merge(spark):
    m = spark.createDataFrame([("c", "body", "the body", "EVIDENCE", "d1", 1), ("c", "anybody", "Anybody", "PERSON", "d1", 2), ("c", "body", "a body", "X", "d2", 3), ("c", "dead_body", "dead body", "EVIDENCE", "d2", 4)], "case_id string, norm string, mention string, label string, source string, ord int")
    p = entities.pool(m, ["case_id"])
    body = p.where("norm = 'body'").first()
    assert (body.global_id, body.entity_type, body.mentions, body.source_docs) == (1, "EVIDENCE", ["the body", "a body"], ["d1", "d2"])
    into = {r.norm: r.into for r in entities.merge_by_words(p, ["case_id"], [["body"]]).collect()}
    assert into == {"body": 1, "anybody": 2, "dead_body": 1}
    assert {r.norm: r.into for r in entities.merge_by_words(p, ["case_id"], [["body"]], whole_words=False).collect()}["anybody"] == 1
    assert one(spark, entities.main_mention(F.col("m")), m=["he", "Ann", "Bob"]) == "Ann"
    assert one(spark, entities.replace_pronouns(F.col("t"), [("he", F.lit("$1 Bob"))]), t="He ran; the hero, he") == "$1 Bob ran; the hero, $1 Bob"


def test_merges_against_brute_force(spark):
    rnd = random.Random(9)
    groups = [["a", "b"], ["c"], ["b"], ["d"]]
    rows = [(k, i, "_".join(rnd.sample("abcdxyz", rnd.randint(1, 3)))) for k in "pqrst" for i in range(1, 15)]
    want = {}
    for k in "pqrst":
        alive, into = {i: n for kk, i, n in rows if kk == k}, {i: i for kk, i, _ in rows if kk == k}
        for words in groups:
            hit = sorted(i for i, n in alive.items() if any(w in n for w in words))
            for i in hit[1:]:
                del alive[i]
                into = {x: hit[0] if y == i else y for x, y in into.items()}
        want |= {(k, i): y for i, y in into.items()}
    got = entities.merge_by_words(spark.createDataFrame(rows, "k string, global_id bigint, norm string"), ["k"], groups, whole_words=False)
    assert {(r.k, r.global_id): r.into for r in got.collect()} == want


def test_case_pipeline(spark):
    n = spark.createDataFrame([(1, "c", "At 9:05 a.m. the guard saw the dog. Victim fell. He observed a body in the kitchen. So\nIt ended at 10:15 a.m. sharp."), (2, "c", None), (3, None, " ")], "id int, case_id string, text string")
    b = spark.createDataFrame([(1, "c", "Title\n\nShe was born on May 3, 1990. Dr. Ray met her.")], "id int, case_id string, biography string")
    i = spark.createDataFrame([(1, "c", "Ann interview\nMonday – 9:07 am\nParticipants:\nAnn: I observed the residence at 9:10 a.m.\nBob:\n")], "id int, case_id string, interview_text string")
    st = casework.run(casework.documents(n, b, i))
    s = {(r.doc_name, r.sentence_id): r for r in st["sentences"].collect()}
    assert s["biography_1", 2].text == "Dr. Ray met her." and s["biography_1", 1].has_time and s["interview_1", 0].speaker == "Ann" and s["interview_1", 0].time == "Monday – 9:07 am"
    assert {(r.text, r.label, r.start, r.end) for r in st["entities"].where("doc_name = 'narrative_1' and label = 'EVIDENCE'").collect()} == {("dog", "EVIDENCE", 31, 34), ("body", "EVIDENCE", 14, 18)}
    assert {r.unified for r in st["unified"].where("sentence_id = 2 and doc_name = 'narrative_1'").collect()} == {"Victim observed a body in the kitchen."}
    rel = {(r.subject, r.predicate, r.object, r.relation_type) for r in st["relations"].collect()}
    assert ("Victim", "observe", "a body in the kitchen", "OBSERVED") in rel and ("I", "observe", "the residence at 9", "OBSERVED") in rel
    e = {r.event_id: r for r in st["events"].collect()}
    assert e["narrative_1_EV2"].locations == ["kitchen"] and e["narrative_1_EV2"].participants == ["body"] and e["interview_1_EV1"].time_resolved == "2022-10-16T09:07:00"
    assert {(r.source_event, r.target_event) for r in st["timeline"].collect()} == {("narrative_1_EV1", "narrative_1_EV2"), ("narrative_1_EV2", "interview_1_EV1")}
    nodes = {r.id: (r.type, r.text) for r in st["nodes"].collect()}
    assert nodes["ENT_body"] == ("Entity", "body") and nodes["LOC_kitchen"] == ("Location", "kitchen") and nodes["TIME_20221016090700"][0] == "Time"
    kinds = {(r.source, r.target, r.edge_type) for r in st["edges"].collect()}
    assert ("ENT_victim", "ENT_body", "OBSERVED") in kinds and ("narrative_1_EV2", "narrative_1_EV1", "AFTER") in kinds
    v = casework.verify(st, 2).first()
    assert v.passed and v.timeline_has_before_after and not casework.verify(st, 50).first().passed
    assert {k: d.count() for k, d in casework.export(st).items()}["documents"] == 3
    empty = casework.run(casework.documents(n.limit(0), b.limit(0), i.limit(0)))
    assert empty["nodes"].count() == 0 and casework.verify(empty).count() == 0


def test_ranks_of_each_case_by_itself(spark):
    one = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f")]
    e = spark.createDataFrame([(k, s, t) for k in "xy" for s, t in (one if k == "x" else one[:3])], "k string, source string, target string")
    nodes = spark.createDataFrame([("x", "z"), ("w", "q")], "k string, id string")
    got = {(r.k, r.id): r.score for r in graph.pagerank_by(e, nodes, "k", 12).collect()}
    for k, extra in (("x", "z"), ("y", None)):
        ex = e.where(F.col("k") == k).selectExpr("1 as edge_id", "source as source_id", "target as target_id")
        alone = graph.pagerank(ex, None if extra is None else spark.createDataFrame([(extra,)], "id string"), 12)
        assert all(abs(got[k, r.id] - r.score) < 1e-4 for r in alone.collect())
    assert got["w", "q"] == pytest.approx(1.0)


def test_events(spark):
    day = date(2022, 10, 16)
    for raw, lenient, strict in [("9:05 am", "09:05", "09:05"), ("9:05 a.m.", "09:05", None), ("12:00 a.m.", "00:00", None), ("12:30 p.m.", "12:30", None), ("13:75 pm", None, None), ("9.30PM", "21:30", "21:30")]:
        d = spark.createDataFrame([(raw, day)], "r string, d date")
        a, b = d.select(events.clock_to_iso(F.col("r"), F.col("d")), events.clock_to_iso(F.col("r"), F.col("d"), strict=True)).first()
        assert a == (lenient and f"2022-10-16T{lenient}:00") and b == (strict and f"2022-10-16T{strict}:00")
    e = spark.createDataFrame([(1, "c", "2022-01-01T10:00:00"), (2, "c", "2022-01-01T10:00:00"), (3, "c", "2022-01-03T09:00:00"), (4, "c", None), (5, "d", "2022-01-01T00:00:00")], "id int, case_id string, time_resolved string")
    assert {(r.source_event, r.target_event) for r in events.before_edges(e).collect()} == {(1, 2), (2, 3)}


def test_pagerank(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f")]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(edges)], "edge_id int, source_id string, target_id string")
    nodes = spark.createDataFrame([("z",)], "id string")
    got = {r.id: r.score for r in graph.pagerank(df, nodes).collect()}
    ids = sorted(got)
    adj = {x: {t for s, t in edges if s == x} for x in ids}
    r = {x: 1 / len(ids) for x in ids}
    for _ in range(200):
        lost = sum(r[x] for x in ids if not adj[x])
        r = {x: 0.15 / len(ids) + 0.85 * (sum(r[y] / len(adj[y]) for y in ids if x in adj[y]) + lost / len(ids)) for x in ids}
    assert all(abs(got[x] - r[x]) < 1e-5 for x in ids) and abs(sum(got.values()) - 1) < 1e-6
    empty = graph.pagerank(df.limit(0))
    assert empty.count() == 0
    stats = graph.score_stats(graph.pagerank(df, nodes)).first()
    assert stats.n <= 10 and stats.threshold == pytest.approx(0.3 * stats.hi)


def test_refine_and_quality(spark):
    e = spark.createDataFrame([(1, "a", "b", "T", "x"), (2, "a", "b", "T", "y"), (3, None, "b", "T", "x"), (4, "a", "b", "U", None)], "edge_id int, source_id string, target_id string, edge_type string, doc string")
    assert sorted((r.edge_type, r.edge_id, r.doc) for r in graph.dedupe_edges(e).collect()) == [("T", 1, "x"), ("U", 4, None)]
    n = spark.createDataFrame([("i", None, None, 2), ("i", "t", "L", 5), (None, "q", "L", 1)], "id string, text string, label string, ord int")
    assert [tuple(r) for r in graph.dedupe_nodes(n).collect()] == [("i", "i", "Unknown", 2)]
    assert quality.orphans(e, "source_id", e.select("target_id"), "target_id").count() == 3
    assert {r.x for r in spark.createDataFrame([("observe",), (" Remove ",), ("be",), ("observe a thing",)], "p string").select(relations.edge_type(relations.relation_type(F.col("p"))).alias("x")).collect()} == {"OBSERVED", None}
    links = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("a", 0, "r"), ("a", 1, "c"), ("b", 0, "d")], "src string, pos int, dst string")
    assert [r.url for r in web.frontier(links, "r", 4).orderBy("visit").collect()] == ["r", "a", "b", "c"]


def test_providers(spark):
    assert providers.parse_reply("```json\n{\"a\": 1}\n```") == {"a": 1} and providers.parse_reply("```json\n    {\n  \"overview\": \"ok\"\n    }\n    ```")["overview"] == "ok"
    assert providers.parse_reply("text [1, 2] more") == [1, 2]
    with pytest.raises(providers.ContentError, match="invalid JSON") as caught:
        providers.parse_reply("```json not valid ```")
    assert caught.value.payload == {"text": "```json not valid ```"}
    with pytest.raises(ValueError):
        providers.make("unknown")
    with pytest.raises(RuntimeError):
        providers.make("grok")
    assert isinstance(providers.make("Gemini", key="foo"), providers.GeminiClient) and isinstance(providers.make("grok", key="bar"), providers.GrokClient)
    sent = []
    g = providers.make("gemini", key="k", transport=lambda r: sent.append(r) or {"candidates": [{"content": {"parts": [{"text": ""}, {"text": "hi"}]}}]})
    assert g(["p"]) == ["hi"] and sent[0]["json"]["contents"][0]["parts"][0]["text"] == "p"
    for reply, message in [({"candidates": []}, "no candidates"), ({"candidates": [{"finishReason": "SAFETY"}], "promptFeedback": {"blockReason": "X"}}, "finishReason=SAFETY, blockReason=X"), ({"status": 429, "error": {"message": "slow down"}}, "slow down")]:
        with pytest.raises(providers.GeminiContentError, match=message):
            providers.make("gemini", key="k", transport=lambda _, r=reply: r)(["p"])
    assert providers.make("grok", key="k", transport=lambda _: {"choices": [{"message": {"content": "yo"}}]})(["p"]) == ["yo"]

    def broken(requests):
        raise RuntimeError("down")

    d = spark.createDataFrame([("x",), (None,)], "t string")
    assert [(r.t, r.reply, r.error) for r in providers.annotate(d, "t", broken).collect()] == [("x", "x", "RuntimeError: down"), (None, "", "RuntimeError: down")]
    assert all(r.error is None for r in providers.annotate(d, "t", providers.make("identity")).collect())
    s = spark.createDataFrame([(1, '{"overview": "o"}'), (2, "no")], "id int, prompt string")
    assert {(r.id, r.reply, (r.reason or "")[:27]) for r in providers.summarised(s, "id", providers.identity).collect()} == {(1, '{"overview": "o"}', ""), (2, None, "the reply has invalid JSON:")}
    rows = spark.createDataFrame([(i, f"n{i}", None) for i in range(250)], "ord int, id string, label string")

    def halve(requests):
        got = __import__("json").loads(requests[0])
        return ["nonsense"] if got[0]["ord"] >= 200 else [__import__("json").dumps(got[:50])]

    kept = sorted(r.ord for r in providers.refine(rows, "ord", halve).collect())
    assert kept == [*range(50), *range(100, 150), *range(200, 250)]


def test_pages(spark):
    html = "<html><head><title> My\n page </title><meta name='description' content='A  b'><style>x{}</style></head><body><h1>Top <b>one</b></h1><h4>no</h4><a href='c.html#p'>c</a><a href='../d'>d</a><a href='//e.example/f'>e</a><a href='javascript:x'>x</a><a href='mailto:a@b'>m</a><a>none</a><p>Text &amp; more<script>var y</script><h3></h3>"
    raw = spark.createDataFrame([("s", 1, "https://a.example/x/y", "200", html), ("s", 2, "https://a.example/z", "200", None)], "site string, page_id int, url string, status string, html string")
    p = {r.page_id: r for r in web.snapshots(raw).collect()}
    assert (p[1].title, p[1].description, p[1].headings) == ("My page", "A b", ["Top one"]) and p[1].links == ["https://a.example/x/c.html", "https://a.example/d", "https://e.example/f"]
    assert "Text & more" in p[1].text and "var y" not in p[1].text and p[2].text == "" and p[2].token_estimate == 1


def test_analysis_counts_links(spark):
    page = lambda i, url, t: ("https://example.com", i, url, "200", "Title", "Description", ["Heading"], [url + "/contact", "https://external.com"], t, len(t.split()), len(t.split()))
    rows = [page(1, "https://example.com", "This is sample text for insights"), page(2, "https://example.com/about", "Another section talking about contact actions")]
    p = spark.createDataFrame(rows, "site string, page_id int, url string, status string, title string, description string, headings array<string>, links array<string>, text string, word_count bigint, token_estimate bigint")
    a = web.analysis(p).first()
    assert (a.total_pages, a.internal_links, a.external_links, a.top_headings) == (2, 2, 2, ["Heading", "Heading"]) and "contact" in " ".join(a.ctas).lower() and a.keywords[:2] == ["this", "sample"]
    s = {(r.section, r.idx): r.line for r in web.site_summary(p, "blocked").collect()}
    assert s["key_sections", 1] == "Title: Description" and s["highlights", 2] == "Internal links: 2 · External links: 2" and "(blocked)" in s["overview", 1]
    assert [r.chunk for r in web.aggregate_text(p, 9).orderBy("page_id").collect()] == ["URL: https://example.com\nThis is sample text for insights", "URL: https://example.com/about\nAnother section talking..."]
    m = {r.idx: r.line for r in payloads.metrics_lines(web.analysis(p)).collect()}
    assert m[0] == "Pages crawled: 2" and m[4] == "CTA links detected: 2"
    assert one(spark, payloads.file_name(F.col("o"), F.col("u")), o="Hi, there!", u="x") == "Hi--there" and one(spark, payloads.file_name(F.col("o"), F.lit(None)), o=" ") == "summary"
    assert web.analysis(p.limit(0)).count() == 0 and web.site_summary(p.limit(0), "x").count() == 0


def test_frontier_queue(spark):
    h = "https://a.example"
    links = spark.createDataFrame([(h, 0, h + "/1"), (h, 1, "https://b.example"), (h, 2, h + "/2"), (h + "/1", 0, h), (h + "/1", 1, h + "/3"), (h + "/2", 0, h + "/4")], "src string, pos int, dst string")
    assert [r.url for r in web.frontier(links, h + "/", 4).orderBy("visit").collect()] == [h, h + "/1", h + "/2", h + "/3"]
    loaded = spark.createDataFrame([(h,), (h + "/2",), (h + "/4",)], "url string")
    assert [r.url for r in web.frontier(links, h, 5, loaded).orderBy("visit").collect()] == [h, h + "/2", h + "/4"]


def test_models(spark):
    assert models.schema("relations").names[:4] == ["id", "case_id", "subject_id", "predicate"] and models.ddl("cases").startswith("CREATE TABLE IF NOT EXISTS cases (case_id STRING")
    c = models.conform(spark.createDataFrame([("x", "t", "extra")], "case_id string, title string, other string"), "cases").first()
    assert c.status == "Open" and c.created_at is None and "other" not in c.asDict()
    t = {
        "cases": spark.createDataFrame([("a",), ("b",)], "case_id string"), "entities": spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "b", 9)], "id bigint, case_id string, global_id bigint"),
        "relations": spark.createDataFrame([(1, "b", 1, 2), (2, "b", 2, 3)], "id bigint, case_id string, subject_id bigint, object_id bigint"), "global_entities": spark.createDataFrame([(7, "a"), (8, "b"), (9, "b")], "global_id bigint, case_id string"),
    }
    assert all(r.n == 0 for r in models.broken(t).collect())
    out = models.delete(t, "cases", t["cases"].where("case_id = 'a'"))
    assert [r.id for r in out["entities"].orderBy("id").collect()] == [2, 3] and [r.id for r in out["relations"].collect()] == [2] and out["global_entities"].count() == 2
    out = models.delete(t, "global_entities", t["global_entities"].where("global_id = 8"))
    assert {r.id: r.global_id for r in out["entities"].collect()} == {1: 7, 2: None, 3: 9}


def test_views_and_nodes(spark):
    e = spark.createDataFrame([(1, "a", "b", "T"), (2, "c", "b", "T"), (3, "d", "d", "T")], "edge_id int, source_id string, target_id string, edge_type string")
    n = spark.createDataFrame([("a", "Entity", "Ann Lee", "PERSON", 1), ("b", "Entity", "Bob", "ORG", 2), ("c", "Location", "yard", None, 3), ("z", "Event", None, None, 4)], "id string, type string, text string, label string, ord int")
    s = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.2), ("d", 0.1)], "id string, score double")
    assert {r.id for r in graph.view(s, n, e).collect()} == {"a", "b", "c"}
    assert [r.id for r in graph.view(s, n, e, around="a", types=["Entity"], labels=["ORG", "PERSON"], significant=True, min_score=0.1, top=1).collect()] == ["b"]
    r = {r.id: (r.text, r.label, r.is_significant) for r in graph.ranked(s, n.drop("ord")).collect()}
    assert r["d"] == ("Unknown", "Unknown", False) and r["b"] == ("Bob", "ORG", True) and r["c"] == ("yard", "Unknown", True)
    assert graph.find_node(n, "A") == "a" and graph.find_node(n, "ann") == "a" and graph.find_node(n, "nobody here") == "z" and graph.find_node(n.limit(0), "x") is None
    assert {(x.id, x.color, x.size) for x in graph.drawn(n.join(s, "id", "left")).collect()} >= {("b", "skyblue", 5500.0), ("z", "lightcoral", 500.0)}


def test_command_line(spark, tmp_path):
    from inkgraph.__main__ import run_step

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "BIO_Ann.txt").write_text("Ann\n\nAnn met the victim in Oak on May 3, 1990.")
    (tmp_path / "in" / "IncidentReport_1.txt").write_text("At 9:05 a.m. the guard saw the dog.")
    timing = run_step(spark, "full", str(tmp_path / "in"), str(tmp_path / "out"), "C1")
    assert timing["total_pipeline_time"] > 0 and {"document_discovery", "events"} <= set(timing)
    assert {r.event_id for r in spark.read.json(str(tmp_path / "out" / "events")).collect()} == {"BIO_Ann_EV1", "IncidentReport_1_EV1"}
    with pytest.raises(FileNotFoundError):
        run_step(spark, "case", str(tmp_path / "none"), str(tmp_path / "out"))


def test_files(spark, tmp_path):
    (tmp_path / "BIO_Ann.txt").write_text("\n Ann's life \nrest")
    (tmp_path / "notes.txt").write_text("x")
    docs = files.case_documents(spark, str(tmp_path), "C1")
    assert [(r.doc_id, r.doc_type, r.title) for r in docs.collect()] == [("BIO_Ann", "biography", "Ann's life")]
    files.save_json(files.manifest(docs), str(tmp_path / "m"))
    assert files.load_json(spark, str(tmp_path / "m"), files.MANIFEST).first().docs[0].doc_id == "BIO_Ann"
    assert files.case_documents(spark, str(tmp_path / "none"), "C1").count() == 0
    assert files.load_json(spark, str(tmp_path / "none"), files.EDGES).count() == 0
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.md").write_bytes("café".encode("latin-1"))
    (tmp_path / "up" / "b.log").write_text("naïve", encoding="utf-8")
    assert {r.name: r.text for r in files.uploads(spark, str(tmp_path / "up")).collect()} == {"a.md": "café", "b.log": "naïve"}
    (tmp_path / "up" / "c.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError):
        files.uploads(spark, str(tmp_path / "up"))
    assert files.uploads(spark, str(tmp_path / "up"), lambda b: ["p1", "p2"]).where("name = 'c.pdf'").first().text == "p1\n\np2"
    paths = files.save_graph(spark.range(2), spark.range(3), str(tmp_path / "g"))
    assert [spark.read.json(x).count() for x in paths] == [2, 3]
    (tmp_path / "doc.json").write_text('{"a": 1}')
    target = files.enriched(spark, str(tmp_path / "doc.json"), "a int", lambda d: d.withColumn("b", F.lit(2)), "_ner")
    assert spark.read.json(target).first().asDict() == {"a": 1, "b": 2}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        files.enriched(spark, str(tmp_path / "bad.json"), "a int", lambda d: d, "_ner")


def test_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5), "view"), (datetime(2024, 1, 1, 0, 50), "view"), (datetime(2024, 1, 1, 5, 0), "click")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    s = timeline.windowed_counts(timeline.event_stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string"))
    run = s.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("view", 2), ("click", 1)}


TIMES = [
    ("1428644951", None, "2015-04-10T05:49:11Z"), ("1545839008194", None, "2018-12-26T15:43:28Z"), ("2020-01-06T16:40:31.676262Z", None, "2020-01-06T16:40:31Z"),
    ("09/11/2024 23:00", "mdy", "2024-09-12T04:00:00Z"), ("09/11/2024 23:00", "dmy", "2024-11-10T05:00:00Z"), ("27-JUN-2014 12:37 EST", "mdy", "2014-06-27T17:37:00Z"), ("Wed, 04 Nov 2015 18:47:52", "mdy", "2015-11-05T00:47:52Z"),
    ("20181113T093340-0600", "mdy", "2018-11-13T15:33:40Z"), ("20160201T072841GMT-5", "mdy", "2016-02-01T12:28:41Z"), ("20221204T180421GMT+5:30", "mdy", "2022-12-04T12:34:21Z"), ("2013-03-20 14:08:19 [Asia/Kolkata]", "mdy", "2013-03-20T08:38:19Z"),
    ("12/11/2014 11:36 pmZ", "mdy", "2014-12-11T23:36:00Z"), ("Thursday, October 14, 2021 – 3:45 AM", "mdy", "2021-10-14T08:45:00Z"), ("9/14/21 0246 hrs", "mdy", "2021-09-14T07:46:00Z"), ("2023-03-12 02:30:00", "mdy", None), ("2023-11-05 01:30:00", "mdy", None),
    ("2023-11-05 01:30:00 CDT", "mdy", "2023-11-05T06:30:00Z"), ("2021-13-40", "mdy", None), ("31/02/2019 10:00", "dmy", None), ("99:99", "mdy", None), ("see log", "mdy", None), (None, "mdy", None), ("", "mdy", None), ("13:05 pm", "mdy", None), ("2013-03-20 14:08:19 [Mars/Base]", "mdy", None),
    ("in 2004", "mdy", "2004"), ("August 1971", "mdy", "1971-08"), ("03/2014", "mdy", "2014-03"), ("Sep. 1978", "mdy", "1978-09"), ("the 18th of April, 1956", "mdy", "1956-04-18"), ("2001-02", "mdy", "2001-02"), ("20000315", "mdy", "2000-03-15"), ("6/26/1963", "mdy", "1963-06-26"), ("c. the flood", "mdy", None),
]


def test_timestamps(spark):
    rows = [(i, t, "America/Chicago", o) for i, (t, o, _) in enumerate(TIMES)]
    got = {r.i: r.instant for r in normalize(spark.createDataFrame(rows, "i int, t string, z string, o string"), "t", "z", "o").collect()}
    assert [got[i] for i in range(len(TIMES))] == [w for _, _, w in TIMES]
    clocks = [("0333 hrs", "2024-01-02T09:33:00Z"), ("0202Z", "2024-01-02T02:02:00Z"), ("12 noon", "2024-01-02T18:00:00Z"), ("midnight", "2024-01-02T06:00:00Z"), ("at 7:39 a.m.,", "2024-01-02T13:39:00Z"), ("9:6x am", None), ("25:10", None), ("13:75 pm", None), ("09h16 CET", "2024-01-02T08:16:00Z"), ("3.29AM", "2024-01-02T09:29:00Z"), ("later", None), (None, None)]
    rows = [(i, t, "America/Chicago", "mdy", date(2024, 1, 2), "extra") for i, (t, _) in enumerate(clocks)]
    out = normalize(spark.createDataFrame(rows, "i int, t string, z string, o string, d date, instant_note string"), "t", "z", "o", "d")
    assert {r.i: r.instant for r in out.collect()} == {i: w for i, (_, w) in enumerate(clocks)}


def test_zone_intervals_against_library():
    from zoneinfo import ZoneInfo

    rnd = random.Random(3)
    for name in ("America/New_York", "Australia/Sydney", "Asia/Kolkata"):
        table = {y: s for _, y, s in zone_intervals([name], (1960, 2030))}
        for _ in range(300):
            at = datetime(rnd.randint(1960, 2030), rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23), rnd.randint(0, 59))
            hits = [o for lo, hi, o in table[at.year] if lo <= at < hi]
            offs = {at.replace(tzinfo=ZoneInfo(name), fold=f).utcoffset().total_seconds() for f in (0, 1)}
            assert len(hits) == 1 and hits[0] in offs or len(offs) == 2


def test_any_year_and_any_number_of_zones(spark, monkeypatch):
    rows = [(0, "1885-06-01 10:00", "America/New_York", "1885-06-01T15:00:00Z"), (1, "1700-06-01 10:00", "America/New_York", "1700-06-01T14:56:02Z"), (2, "2150-06-01 10:00", "America/New_York", "2150-06-01T14:00:00Z"), (3, "2150-01-01 10:00", "Australia/Sydney", "2149-12-31T23:00:00Z"), (4, "0985-06-01 10:00", "America/New_York", None), (5, "2024-06-01 10:00", None, None)]
    junk = [(10 + i, "2024-06-01 10:00", f"Junk/Zone{i}", None) for i in range(200)]
    d = spark.createDataFrame([(i, t, z, "mdy") for i, t, z, _ in rows + junk], "i int, t string, z string, o string")
    want = {i: w for i, _, _, w in rows + junk}
    got = {r.i: (r.instant, r.status) for r in normalize(d, "t", "z", "o").collect()}
    assert {i: x for i, (x, _) in got.items()} == want and all(got[i][1] == "no_zone" for i in (5, 10, 209))
    monkeypatch.setattr(timestamps, "BROADCAST_ROWS", 0)  # the way of a table too large to broadcast
    assert {r.i: (r.instant, r.status) for r in normalize(d, "t", "z", "o").collect()} == got


def test_case_times_empty(spark):
    ev = spark.createDataFrame([], "id bigint, agency_code string, ts_raw string, time_raw string, case_date date")
    bio = spark.createDataFrame([(1, None, None)], "id bigint, agency_code string, segments array<struct<time_text:string,seg_text:string>>")
    ag = spark.createDataFrame([], "agency_code string, zone_id string, date_order string")
    assert case_times(ev, bio, ag).count() == 0


def parse(*rows):
    return [dict(zip(("text", "lemma", "pos", "dep", "ent", "head"), r, strict=True)) for r in rows]


def test_triples_and_patterns(spark):
    s = parse(("The", "the", "DET", "det", "", 1), ("officer", "officer", "NOUN", "nsubj", "ROLE", 2), ("arrived", "arrive", "VERB", "ROOT", "", -1), ("at", "at", "ADP", "prep", "", 2), ("home", "home", "NOUN", "pobj", "", 3))
    assert parses.triples_of(s) == [{"subject": "The officer", "predicate": "arrive", "object": "home"}] and parses.triples_of([]) == []
    m = parse(("Ann", "Ann", "PROPN", "nsubj", "PERSON", 1), ("interviewed", "interview", "VERB", "ROOT", "", -1), ("Bob", "Bob", "PROPN", "dobj", "PERSON", 1))
    assert parses.matches_of(m) == [{"subject": "Ann", "predicate": "interviewed", "object": "Bob", "relation_type": "INTERVIEWED"}]
    born = parse(("Ann", "Ann", "PROPN", "nsubjpass", "PERSON", 2), ("was", "be", "AUX", "auxpass", "", 2), ("born", "bear", "VERB", "ROOT", "", -1), ("to", "to", "ADP", "prep", "", 2), ("Eve", "Eve", "PROPN", "pobj", "PERSON", 3), ("Oak", "Oak", "PROPN", "flat", "PERSON", 4))
    got = [(r["subject"], r["relation_type"], r["object"]) for r in parses.matches_of(born)]
    assert got == [("Eve", "HAS_CHILD", "Ann"), ("Ann", "HAS_PARENT", "Eve"), ("Eve", "HAS_CHILD", "Ann"), ("Oak", "HAS_CHILD", "Ann"), ("Ann", "HAS_PARENT", "Eve and Oak")]
    well = parse(("Ann", "Ann", "PROPN", "nsubj", "PERSON", 3), ("and", "and", "CCONJ", "cc", "", 0), ("Eve", "Eve", "PROPN", "conj", "PERSON", 0), ("got", "get", "VERB", "ROOT", "", -1), ("along", "along", "ADV", "prt", "", 3), ("well", "well", "ADV", "advmod", "", 3))
    assert {(r["subject"], r["predicate"], r["object"]) for r in parses.matches_of(well)} == {("Ann", "got along well", "Eve"), ("Eve", "has sibling", "Ann")}
    told = parse(("Ann", "Ann", "PROPN", "nsubj", "PERSON", 1), ("told", "tell", "VERB", "ROOT", "", -1), ("Eve", "Eve", "PROPN", "dobj", "PERSON", 1), ("Ann", "Ann", "PROPN", "nsubj", "PERSON", 4), ("said", "say", "VERB", "ccomp", "", 1))
    assert {(r["relation_type"], r["object"]) for r in parses.matches_of(told)} == {("TOLD", "Eve"), ("STATED", "Ann said")}
    d = spark.createDataFrame([(1, s), (2, None)], f"id int, p array<{parses.TOKEN}>")
    assert {r.id: len(r.t) for r in d.select("id", parses.triples("p").alias("t")).collect()} == {1: 1, 2: 0}
    t = spark.createDataFrame([(1, "Deputy Ray secured the back door."), (2, ""), (3, None)], "id int, s string")
    rows = {r.id: r for r in parses.attach(t, "s").collect()}
    assert rows[1].root_index == 2 and rows[1].has_dependencies and not rows[2].has_dependencies and rows[3].root_index is None
    assert parses.triples_of(parses.shallow_of("Deputy Ray secured the back door.")) == [{"subject": "Deputy Ray", "predicate": "secure", "object": "the back door"}]


def test_payloads(spark):
    rows = [(1, '{"overview": "o", "content_type": "x", "sections": {"next_steps": ["a", "b"], "none": []}}'), (2, '```json\n{"overview": "p", "highlights": ["h"]}\n```'), (3, "bad")]
    d = spark.createDataFrame(rows, "id int, t string").select("id", payloads.summary(F.col("t")).alias("s"))
    got = {(r.id, r.section, r.idx, r.line) for r in payloads.report(d, "id", "s").collect()}
    assert got == {(1, "Next Steps", 0, "a"), (1, "Next Steps", 1, "b"), (2, "Highlights", 0, "h")}


def test_fallback_chain(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", "a")], "edge_id int, source_id string, target_id string")
    scores, name = graph.ranks_or_fallback(e)
    assert name == "pagerank" and scores.count() == 3
    top = {r.id: r.score for r in graph.eigenvector(e).collect()}
    assert top["a"] == max(top.values()) == 1.0


def test_eigenvector_settles(spark):
    ends = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")]
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(ends)], "edge_id int, source_id string, target_id string")
    got = {r.id: r.score for r in graph.eigenvector(e).collect()}
    into = {k: sum(got[s] for s, t in ends if t == k) for k in got}
    ratio = into["c"] / got["c"]
    assert all(abs(into[k] - ratio * got[k]) < 1e-4 for k in got) and graph.eigenvector(e.limit(0)).count() == 0
