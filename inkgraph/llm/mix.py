"""Problem 9: mixing sources to target weights.

Method: min-cost flow for overlapping sources.  Texts are grouped by what they are (a text handed in under several ids or
sources is one text), and texts by their membership pattern, the set of the mix's sources that hold them.  A flow network
carries tokens from patterns to source quotas: each pattern offers its tokens once at cost 0 and each further repetition
at a rising (convex) cost, so repetition is used only where quotas ask for it and never beyond a source's cap.  The flow
of each pattern and source is an interval on the seeded order of the pattern's texts, run around as often as needed; a
text is drawn for a source as often as its position falls into that source's interval.

Scale.  Only the aggregated patterns (at most ``MAX_PATTERNS``, checked) come to the driver.  Positions are prefix sums over
hash buckets, whose number follows the number of texts: bucket sums are aggregated first, and only the order inside a bucket
needs a window, so a source with a third of all rows is spread over all tasks.  Nothing is sampled or dropped before the selection.

Edge cases: null and blank texts and null sources are never drawn; a source that no document has gets nothing and is
reported with 0; quotas that the caps do not allow are filled as far as they go and reported; ties in the seeded order
are broken by the text's hash; repeated rows of a text count once; empty tables give no draws but a full report.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.tokens import token_count
from inkgraph.session import cut

MAX_PATTERNS = 20_000
#: Texts that a bucket of the seeded order holds on average.
PER_BUCKET = 5_000


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a cheapest maximum flow, by successive shortest paths."""
    to, cap, price, head = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in edges:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            head[a].append(len(to))
            to.append(b)
            cap.append(x)
            price.append(y)
    while True:
        dist, via, inside = [float("inf")] * n, [-1] * n, [False] * n
        dist[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            inside[u] = False
            for e in head[u]:
                if cap[e] > 0 and dist[u] + price[e] < dist[to[e]]:
                    dist[to[e]] = dist[u] + price[e]
                    via[to[e]] = e
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        queue.append(to[e])
        if via[sink] < 0:
            break
        push, v = None, sink
        while v != source:
            push = cap[via[v]] if push is None else min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
    return [cap[2 * i + 1] for i in range(len(edges))]


def plan(patterns: dict[tuple[str, ...], int], targets: list[tuple[str, float, int]], size: float) -> dict[tuple[tuple[str, ...], str], tuple[int, int]]:
    """(pattern, source) -> interval of tokens on the pattern's order.  ``targets``: (source, share, most repeats)."""
    ps = sorted(p for p, v in patterns.items() if v > 0)
    ss = [s for s, _, _ in targets]
    share = {s: x for s, x, _ in targets}
    most = {s: max(0, k) for s, _, k in targets}
    node_p = {p: 1 + i for i, p in enumerate(ps)}
    node_s = {s: 1 + len(ps) + i for i, s in enumerate(ss)}
    sink = 1 + len(ps) + len(ss)
    edges, which = [], {}
    for p in ps:
        levels = max((most[s] for s in p if s in most), default=0)
        for k in range(levels):
            edges.append((0, node_p[p], patterns[p], k * k))
        for s in p:
            if s in node_s and most[s]:
                which[p, s] = len(edges)
                edges.append((node_p[p], node_s[s], most[s] * patterns[p], 0))
    for s in ss:
        edges.append((node_s[s], sink, max(0, round(share[s] * size)), 0))
    flow = min_cost_flow(sink + 1, edges, 0, sink)
    out: dict[tuple[tuple[str, ...], str], tuple[int, int]] = {}
    at: dict[tuple[str, ...], int] = {}
    for (p, s), e in sorted(which.items(), key=lambda x: (x[0][0], ss.index(x[0][1]))):
        if flow[e]:
            a = at.get(p, 0)
            out[p, s] = (a, a + flow[e])
            at[p] = a + flow[e]
    return out


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, tokens) of the documents; the key stands for the text."""
    key = F.sha2(F.trim("text"), 256)
    return cut(documents.select("doc_id", "source", F.when(F.length(F.trim("text")) > 0, key).alias("text_key"), token_count("text").alias("tokens")))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(mix_id, source, doc_id, repeats, tokens) of every mix in ``targets``; ``docs``: what :func:`sized` gives.

    ``repeats``: how often the document is drawn for that source; ``tokens``: its size, once.
    """
    spark = docs.sparkSession
    rows = targets.where("source is not null").collect()  # a small table of wanted shares
    total, n_docs = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    buckets_ = max(1, -(-n_docs // PER_BUCKET))
    out = None
    for mix_id in sorted({r.mix_id for r in rows}):
        own = [r for r in rows if r.mix_id == mix_id]
        names = [r.source for r in own]
        # one row per text: its sources and the first document of each
        usable = docs.where(F.col("source").isin(names) & F.col("text_key").isNotNull() & (F.col("tokens") > 0))
        per_source = usable.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.min_by("tokens", "doc_id").alias("tokens"))
        texts = per_source.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id", "tokens"))).alias("held"), F.max("tokens").alias("tokens"))  # a row per source
        texts = cut(texts.select("text_key", "held", "tokens", F.array_join("held.source", "\u0001").alias("pattern"), F.pmod(F.xxhash64(F.lit(seed), "text_key"), F.lit(buckets_)).alias("bucket"), F.xxhash64(F.lit(seed + 1), "text_key").alias("order")))
        sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("v")).limit(MAX_PATTERNS + 1).collect()
        if len(sums) > MAX_PATTERNS:
            raise ValueError("more membership patterns than a plan is made for")
        volume = {tuple(r.pattern.split("\u0001")): int(r.v) for r in sums}
        intervals = plan(volume, [(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in own], float(own[0].total_ratio or 0) * total)
        if not intervals:
            continue
        table = spark.createDataFrame([("\u0001".join(p), s, a, b, volume[p]) for (p, s), (a, b) in intervals.items()], "pattern string, source string, a bigint, b bigint, v bigint")
        buckets = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("in_bucket"))
        before = F.sum("in_bucket").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        buckets = buckets.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("base"))  # a row per pattern and bucket
        inner = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "text_key").rowsBetween(Window.unboundedPreceding, -1))
        placed = texts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(buckets, ["pattern", "bucket"]).withColumn("pos", F.col("base") + F.col("inner"))
        drawn = placed.join(F.broadcast(table), "pattern")  # as many rows as the plan has
        turns = F.ceil((F.col("b") - F.col("pos")) / F.col("v")) - F.ceil((F.col("a") - F.col("pos")) / F.col("v"))
        drawn = drawn.withColumn("repeats", turns.cast("int")).where("repeats > 0")
        doc = F.filter("held", lambda h: h["source"] == F.col("source"))[0]
        part = drawn.select(F.lit(mix_id).cast("int").alias("mix_id"), "source", doc["doc_id"].alias("doc_id"), "repeats", doc["tokens"].alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "mix_id int, source string, doc_id bigint, repeats int, tokens bigint")


def shares(drawn: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target share, reached share (of what was drawn) and share of the wanted size, quota and drawn tokens, documents and the most repeats."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("repeats_used"))
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    t = targets.select(F.col("mix_id").cast("int"), "source", "target_share", "max_repeats", "total_ratio")
    joined = t.join(got, ["mix_id", "source"], "left").fillna(0, ["drawn_tokens", "n_docs", "repeats_used"]).crossJoin(F.broadcast(total))
    all_ = F.sum("drawn_tokens").over(Window.partitionBy("mix_id"))  # a mix has as many rows as sources
    return joined.select("mix_id", "source", "target_share", F.round(F.when(all_ > 0, F.col("drawn_tokens") / all_).otherwise(0.0), 6).alias("reached_share"), F.round(F.when(F.col("total_ratio") * F.col("corpus_tokens") > 0, F.col("drawn_tokens") / (F.col("total_ratio") * F.col("corpus_tokens"))).otherwise(0.0), 6).alias("share_of_wanted"), F.round(F.col("target_share") * F.col("total_ratio") * F.col("corpus_tokens")).cast("bigint").alias("quota_tokens"), "drawn_tokens", "n_docs", "repeats_used", "max_repeats")
