"""Knowledge-graph construction, ranking, views and refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.operators.ordered import position
from inkgraph.session import written


def first_by(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The first row of each key: a mergeable aggregate, so hot keys are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_f")).select(*keys, "_f.*")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with an id, first row first, missing text and label repaired."""
    ok = nodes.where("id is not null and trim(id) != ''")
    out = first_by(ok, ["id"], "ord", ["text", "label", "ord"])
    return out.select("id", F.coalesce("text", "id").alias("text"), F.coalesce("label", F.lit("Unknown")).alias("label"), "ord")


def dedupe_edges(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """Edges with both ends and a type, the first of each (source, target, type)."""
    ok = edges.where("source_id is not null and target_id is not null and edge_type is not null")
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "edge_type")]
    return first_by(ok, ["source_id", "target_id", "edge_type"], order, rest)


def chunks(df: DataFrame, order: str, size: int = 100, width: int = 10_000) -> DataFrame:
    """Rows numbered into chunks of ``size`` along a numeric order, without sorting everything in one task."""
    out = position(df, [], F.floor(F.col(order) / width), [order], "_n")
    return out.withColumn("chunk", F.floor(F.col("_n") / size).cast("bigint")).drop("_n")


def endpoint(phrase: Column, rules: list[tuple[str, str]]) -> Column:
    """A phrase mapped to an id by ordered (pattern, id) rules; null when none fits.  Rules are data, not code."""
    out = None
    for pattern, ident in rules:
        hit = F.lower(phrase).rlike(pattern)
        out = F.when(hit, F.lit(ident)) if out is None else out.when(hit, F.lit(ident))
    return out if out is not None else F.lit(None).cast("string")


def canonical_end(norm: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """The node of a relation's end: by the first rule (``is``: the whole phrase, ``has``: in it) that fits, else the phrase's own."""
    own = F.concat(F.lit("ENT_"), F.replace(norm, F.lit(" "), F.lit("_")))
    out = None
    for how, words, ident in rules:
        hit = norm == words if how == "is" else norm.contains(words)
        value = own if ident is None else F.lit(ident)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return own if out is None else out.otherwise(own)


def pagerank_by(edges: DataFrame, nodes: DataFrame, key: str, iterations: int | None = None, alpha: float = 0.85, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """(key, id, score): PageRank of the graph of each key by itself, as :func:`pagerank` does it for one.

    ``edges``: (key, source, target), ``nodes``: (key, id).  Lost mass is spread within its key; all keys iterate together
    until the largest of their changes per node is below ``tol``.
    """
    adj = written(edges.select(key, F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    deg = adj.groupBy(key, F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    ids = nodes.select(key, "id").union(adj.select(key, "src")).union(adj.select(key, "dst")).distinct()
    size = ids.groupBy(key).agg(F.count("*").alias("n"))
    ranks = written(ids.join(deg, [key, "id"], "left").join(size, key).select(key, "id", "deg", "n", (1.0 / F.col("n")).alias("score")))
    last = None
    for _ in range(iterations or most):
        gave = ranks.where("deg is not null").select(key, F.col("id").alias("src"), (F.col("score") / F.col("deg")).alias("give"))
        got = adj.join(gave, [key, "src"]).groupBy(key, F.col("dst").alias("id")).agg(F.sum("give").alias("got"))
        lost = ranks.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("score"))), F.lit(0.0)).alias("lost"))
        new = ranks.withColumnRenamed("score", "old").join(got, [key, "id"], "left").join(lost, key)
        new = written(new.select(key, "id", "deg", "n", "old", ((1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("score")), over=last)
        last = new
        ranks = new.drop("old")
        if iterations is None:
            change = new.groupBy(key).agg((F.sum(F.abs(F.col("score") - F.col("old"))) / F.first("n")).alias("c")).agg(F.max("c")).first()[0]
            if change is None or change < tol:
                break
    return ranks.select(key, "id", "score")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, iterations: int | None = None, alpha: float = 0.85, tol: float = 1e-6, most: int = 100, every: int = 4) -> DataFrame:
    """(id, score): unweighted PageRank with parallel edges collapsed and dangling mass spread evenly.

    A fixed number of ``iterations``, or until the L1 change is below n * ``tol``.  Contributions are summed per target
    before the shuffle, so a target with a tenth of all edges is no hot task; lineage is cut every few rounds.
    """
    adj = adjacency(edges)
    ends = adj.select(F.col("src").alias("id")).union(adj.select(F.col("dst").alias("id")))
    ids = (ends if nodes is None else ends.union(nodes.select("id"))).distinct()
    out_deg = adj.groupBy("src").agg(F.count("*").alias("deg"))
    ids = written(ids.join(out_deg.withColumnRenamed("src", "id"), "id", "left"))
    adj = written(adj)
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    ranks, last = ids.select("id", "deg", F.lit(1.0 / n).alias("score")), None
    for i in range(iterations or most):
        gave = ranks.where("deg is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("deg")).alias("give"))
        got = adj.join(gave, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("give").alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("score"))), F.lit(0.0)).alias("lost"))
        new = ranks.select("id", "deg", F.col("score").alias("old")).join(got, "id", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", "deg", "old", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        if iterations is None or (i + 1) % every == 0:
            new = last = written(new, over=last)
        if iterations is None and new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tol:
            return new.select("id", "score")
        ranks = new.select("id", "deg", "score")
    return ranks.select("id", "score")


def degree_centrality(edges: DataFrame) -> DataFrame:
    adj = adjacency(edges)
    both = adj.select(F.col("src").alias("id")).unionAll(adj.select(F.col("dst").alias("id")))
    deg = both.groupBy("id").agg(F.count("*").alias("deg"))
    n = deg.agg(F.count("*").alias("n"))
    return deg.crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.col("deg") / (F.col("n") - 1)).otherwise(0.0).alias("score"))


def eigenvector(edges: DataFrame, iterations: int | None = None, tol: float = 1e-6, most: int = 1000) -> DataFrame:
    """(id, score): eigenvector centrality over in-edges by power iteration, scaled to a greatest score of 1.

    A fixed number of ``iterations``, or until a round's L1 change is below ``tol`` of the sum of scores: few nodes of a
    large graph have a score, so a change per node would stop too early.  Each round reads the last one twice, so
    every round is written.
    """
    adj = written(adjacency(edges))
    ids = written(adj.select(F.col("src").alias("id")).union(adj.select(F.col("dst").alias("id"))).distinct())
    ranks, last = ids.withColumn("score", F.lit(1.0)), None
    for _ in range(iterations or most):
        got = adj.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        new = ranks.withColumnRenamed("score", "old").join(got, "id", "left").select("id", "old", (F.col("old") + F.coalesce("got", F.lit(0.0))).alias("score"))
        new = last = written(new, over=last)
        top = new.agg(F.max("score")).first()[0]
        if top is None:
            break
        ranks = new.select("id", (F.col("score") / top).alias("score"))
        if iterations is None and new.agg(F.sum(F.abs(F.col("score") / top - F.col("old"))) < tol * F.sum("score") / top).first()[0]:
            break
    return ranks


def ranks_or_fallback(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Scores and the method that gave them: PageRank, with more rounds, eigenvector centrality, then degrees."""
    for name, f in (("pagerank", lambda: pagerank(edges, nodes)), ("pagerank_200", lambda: pagerank(edges, nodes, most=200)), ("eigenvector", lambda: eigenvector(edges)), ("degree", lambda: degree_centrality(edges))):
        scores = f()
        bad = scores.where(F.isnan("score") | F.col("score").isNull()).limit(1).count()
        if not bad:
            return scores, name
    return scores, name


def score_stats(scores: DataFrame) -> DataFrame:
    """One row: n, min, max, mean, median and the significance threshold (mean + half a sample deviation; 0.3 max up to ten)."""
    s = scores.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.stddev_samp("score").alias("sd"))
    return s.withColumn("threshold", F.when(F.col("n") > 10, F.col("mean") + 0.5 * F.col("sd")).otherwise(0.3 * F.col("hi")))


def ranked(scores: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, score, is_significant) and, with ``nodes`` (id, text, label), their text and label; ``Unknown`` where there is no node."""
    stats = score_stats(scores).select("threshold")
    out = scores.crossJoin(F.broadcast(stats)).select("id", "score", (F.col("score") >= F.col("threshold")).alias("is_significant"))  # one row
    if nodes is None:
        return out
    named = out.join(nodes.select("id", "text", "label"), "id", "left")
    return named.withColumns({"text": F.coalesce("text", F.lit("Unknown")), "label": F.coalesce("label", F.lit("Unknown"))})


def view(scores: DataFrame, nodes: DataFrame, edges: DataFrame, around: str | None = None, types: list[str] | None = None, labels: list[str] | None = None, significant: bool = False, min_score: float | None = None, top: int | None = None) -> DataFrame:
    """Nodes (id, type, label, text, score) that pass all given filters, in this order: connected, near a node, of types, of labels, significant, scored, best.

    Nodes without a score have 0.  ``top`` is a top-k report; ties go to the smaller id.
    """
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id")))
    rows = nodes.join(ends, "id", "left_semi")
    if around is not None:
        near = neighbourhood(edges, around).select("id").union(nodes.where(F.col("id") == around).select("id"))
        rows = rows.join(near, "id", "left_semi")
    rows = rows.where(F.col("type").isin(types)) if types else rows
    rows = rows.where(F.col("label").isin(labels)) if labels else rows
    rows = rows.join(ranked(scores), "id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "is_significant": F.coalesce("is_significant", F.lit(False))})
    rows = rows.where("is_significant") if significant else rows
    rows = rows.where(F.col("score") >= min_score) if min_score is not None else rows
    rows = rows.orderBy(F.desc("score"), "id").limit(top) if top is not None else rows
    return rows.select("id", "type", "label", "text", "score")


def drawn(nodes: DataFrame) -> DataFrame:
    """Nodes (id, type, score) with the colour of their type and a size by their score."""
    colour = F.when(F.col("type") == "Entity", "skyblue").when(F.col("type") == "Event", "lightcoral").when(F.col("type") == "Location", "lightgreen").otherwise("gray")
    return nodes.withColumns({"color": colour, "size": 500 + F.coalesce("score", F.lit(0.0)) * 10000})


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("source_id")), nodes.select(F.col("id").alias("target_id"))
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def find_node(nodes: DataFrame, name: str) -> str | None:
    """The id of a node by its id, else of the first one (by ``ord``) whose text holds the name or is held by it.

    A node without text matches every name, as a text of no length is held by all.
    """
    low = name.lower().replace("_", " ")
    exact = nodes.where(F.lower("id") == low).agg(F.min_by("id", "ord")).first()[0]
    if exact is not None:
        return exact
    shown = F.lower(F.coalesce("text", F.lit("")))
    return nodes.where(F.contains(shown, F.lit(low)) | F.contains(F.lit(low), shown)).agg(F.min_by("id", "ord")).first()[0]


def neighbourhood(edges: DataFrame, ident: str) -> DataFrame:
    """(id, direction) of the nodes one step from a node."""
    out = edges.where(F.col("source_id") == ident).select(F.col("target_id").alias("id"), F.lit("out").alias("direction"))
    into = edges.where(F.col("target_id") == ident).select(F.col("source_id").alias("id"), F.lit("in").alias("direction"))
    return out.union(into).where("id is not null").distinct()
