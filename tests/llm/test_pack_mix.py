"""Problems 8 and 9."""

import random

import numpy as np
from pyspark.sql import functions as F

from inkgraph.llm import mix, pack, tokens


def test_token_count(spark):
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("日本語 text",)], "t string")
    assert [r.n for r in d.select(tokens.token_count("t").alias("n")).collect()][:3] == [2, 0, 0]


def test_best_fit_against_brute_force():
    rnd = random.Random(1)
    for _ in range(50):
        c = rnd.randint(5, 40)
        sizes = np.array([rnd.randint(0, c) for _ in range(rnd.randint(0, 60))], dtype=np.int64)
        bins = pack.best_fit(sizes, c)
        space, used = [], []
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] == 0:
                continue
            fit = [(s, k) for k, s in enumerate(space) if s >= sizes[i]]
            if fit:
                best = min(s for s, _ in fit)
                k = next(k for s, k in fit if s == best)
                space[k] -= sizes[i]
            else:
                space.append(c - sizes[i])
            used.append(i)
        load = np.bincount(bins, weights=sizes) if len(sizes) else np.zeros(1)
        assert load.max(initial=0) <= c and (load > 0).sum() == len(space) >= pack.lower_bound(sizes, c)


def test_lower_bound_is_sound():
    assert pack.lower_bound(np.array([6, 6, 6]), 10) == 3 and pack.lower_bound(np.array([4, 4, 4, 4]), 10) == 2 and pack.lower_bound(np.array([], dtype=np.int64), 10) == 0


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(pack, "ITEMS", 40)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 3, 5, 7, 10, 23, 40])) for i in range(300)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    specs = spark.createDataFrame([(1, 10), (2, 16)], "pack_id int, capacity_tokens int")
    out = pack.pack(sizes, specs).toPandas()
    for pid, cap in ((1, 10), (2, 16)):
        o = out[out.pack_id == pid]
        assert o.groupby("doc_id").tokens.sum().to_dict() == dict(rows)
        assert o.groupby("bin_id").tokens.sum().max() <= cap
        pieces = o.groupby("doc_id").size().to_dict()
        assert all(pieces[d] == max(1, -(-t // cap)) for d, t in rows)
    rep = {r.pack_id: r for r in pack.report(pack.pack(sizes, specs), specs).collect()}
    assert all(r.n_bins >= r.lower_bound and r.fill > 0.9 for r in rep.values())
    assert pack.pack(sizes.limit(0), specs).count() == 0 and pack.pack(sizes, specs.limit(0)).count() == 0


def test_flow_prefers_single_use():
    p = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    got = mix.plan(p, [("a", 0.5, 1), ("b", 0.5, 3)], 220)
    for_a = sum(e - s for (_, k), (s, e) in got.items() if k == "a")
    for_b = sum(e - s for (_, k), (s, e) in got.items() if k == "b")
    assert for_a == 110 and for_b == 110 and got[("a",), "a"] == (0, 100)


def test_mix(spark):
    rows = [(i, "big", f"word {i} " * 5) for i in range(200)] + [(1000 + i, "small", f"tiny {i} " * 5) for i in range(10)] + [(2000, "big", "word 1 " * 5), (2001, None, "lost"), (2002, "small", None), (2003, "small", " ")]
    docs = mix.sized(spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("clash")).drop("tokens"))
    targets = spark.createDataFrame([(1, "big", 0.8, 1, 0.5), (1, "small", 0.2, 3, 0.5), (1, "absent", 0.0, 2, 0.5)], "mix_id int, source string, target_share double, max_repeats int, total_ratio double")
    drawn = mix.mix(docs, targets)
    got = drawn.toPandas()
    assert got[got.source == "big"].repeats.max() == 1 and got[got.source == "small"].repeats.max() <= 3 and not got.doc_id.isin([2000, 2001, 2002, 2003]).any()
    share = {r.source: r for r in mix.shares(drawn, docs, targets).collect()}
    total = docs.agg(F.sum("tokens")).first()[0]
    assert abs(share["big"].drawn_tokens - 0.4 * total) <= 40 and abs(share["small"].drawn_tokens - min(0.1 * total, 3 * 10 * 20)) <= 60 and share["absent"].drawn_tokens == 0
    assert {tuple(r) for r in mix.mix(docs, targets).collect()} == {tuple(r) for r in drawn.collect()}
    assert mix.mix(docs.limit(0), targets).count() == 0 and mix.mix(docs, targets.limit(0)).count() == 0
