"""Problem 8: items of varying length into containers of fixed capacity.

Method: bound-certified repacking.  Items are dealt to partitions by hash and each partition packs its items by best-fit
decreasing; dual-feasible functions over the partition's histogram of sizes give a lower bound on its number of
containers.  Where the two agree the partition is certified and done.  Partitions with a gap give up their containers that
are not full and, by a seeded choice, a quarter of their full ones; the items of those exchange (are dealt anew with another
seed) and are packed again by best-fit decreasing.  A capacity keeps the result of a round where it saves containers; after
``ROUNDS`` rounds, or where no partition has a gap, the packing stands.  A capacity whose items fit one partition exchanges
within it: the full containers that are opened bring other items to the gaps.

Scale.  The number of partitions follows the number of items (``ITEMS`` each), so no task ever holds more; the deal is by
hash of the item, never by source or case, so hot keys do not matter.  Each round moves only the items of containers with
space left.  Only counts per capacity come to the driver.

Edge cases: an item larger than the capacity is cut into pieces, full ones first, and only then; items of size 0 (null or
blank texts) lie in the first container of their partition and take no space; capacities below 1 are refused; ties are
broken by doc_id; repeated rows under the same id are packed as the items they are; no items give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.tokens import token_count
from inkgraph.session import cut

ITEMS = 60_000
ROUNDS = 3
#: Kinds of containers up to which their table is broadcast.
MAX_KINDS = 10_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of these sizes needs, by the best of several dual-feasible functions."""
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    return lower_bound_of(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1], capacity)


def lower_bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from a histogram of sizes from 0 to the capacity."""
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)  # the identity
    half = capacity // 2
    for k in {int(v) for v in np.unique(np.linspace(1, half, 64).astype(int))} if half else ():
        # sizes above C - k count whole, those below k nothing
        f = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
        best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 24):
        # stepwise: x where (k + 1) x / C is whole, else the step below it
        whole = ((k + 1) * x) % capacity == 0
        f = np.where(whole, x * k, ((k + 1) * x // capacity) * capacity)
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item by best-fit decreasing; the order of equal sizes is the given one."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), dtype=np.int64)
    by_space: dict[int, list[int]] = {}
    spaces = 0  # a bit for each amount of free space that some container has
    n = 0
    for i in order:
        s = int(sizes[i])
        if s == 0:
            out[i] = 0
            continue
        fit = spaces >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            bin_ = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, bin_ = capacity, n
            n += 1
        out[i] = bin_
        left = space - s
        if left:
            by_space.setdefault(left, []).append(bin_)
            spaces |= 1 << left
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
    sizes = pdf["tokens"].to_numpy(dtype=np.int64)
    capacity = int(pdf["capacity"].iloc[0])
    bins = best_fit(sizes, capacity)
    used = np.bincount(bins, weights=sizes)
    pdf = pdf.assign(bin=bins, free=capacity - used[bins].astype(np.int64), bins_used=int((used > 0).sum()), bound=lower_bound(sizes, capacity))
    return pdf[["pack_id", "capacity", "doc_id", "piece_no", "tokens", "part", "bin", "free", "bins_used", "bound"]]


ITEM = "pack_id int, capacity int, doc_id bigint, piece_no int, tokens bigint, part int, bin bigint, free bigint, bins_used bigint, bound bigint"


def _deal(items: DataFrame, parts: int, seed: int) -> DataFrame:
    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece_no"), F.lit(parts)).cast("int"))
    return dealt.groupBy("pack_id", "part").applyInPandas(_pack, ITEM)


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_id, bin_id, doc_id, piece_no, tokens) for rows (doc_id, tokens) and containers (pack_id, capacity_tokens)."""
    bad = specs.where("capacity_tokens < 1 or capacity_tokens is null").limit(1).count()
    if bad:
        raise ValueError("a capacity below 1")
    spec = specs.select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("int").alias("capacity"))
    n_specs = spec.count()  # a small table of container kinds
    if not n_specs:
        return sizes.sparkSession.createDataFrame([], "pack_id int, bin_id string, doc_id bigint, piece_no int, tokens bigint")
    items = sizes.crossJoin(F.broadcast(spec) if n_specs <= MAX_KINDS else spec)  # every item goes into every kind of container
    pieces = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(pieces - 1, F.lit(0)))))
    items = items.withColumn("tokens", F.when(F.col("tokens") > F.col("capacity"), F.least(F.col("capacity").cast("bigint"), F.col("tokens") - F.col("piece_no") * F.col("capacity"))).otherwise(F.col("tokens")))
    items = items.select("pack_id", "capacity", F.col("doc_id").cast("bigint"), "piece_no", "tokens")
    full = items.where("tokens = capacity").select("pack_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece_no").alias("bin_id"), "doc_id", "piece_no", "tokens")
    rest = items.where("tokens < capacity")
    n = sizes.count()
    packed = cut(_deal(rest, max(1, -(-n // ITEMS)), 0).withColumn("round", F.lit(0)))
    name = F.concat_ws("-", F.col("round").cast("string"), F.col("part").cast("string"), F.col("bin").cast("string"))
    done = packed
    for r in range(1, ROUNDS + 1):
        # containers with space left, of partitions whose bound leaves a gap; the others are certified
        opened = (F.col("free") > 0) | (F.pmod(F.xxhash64(F.lit(100 + r), "round", "part", "bin"), F.lit(4)) == 0)
        gap = (F.col("bins_used") > F.col("bound")) & opened & (F.col("tokens") > 0)
        loose = done.where(gap)
        before = {x.pack_id: (x.bins, x.items) for x in loose.groupBy("pack_id").agg(F.count_distinct("round", "part", "bin").alias("bins"), F.count("*").alias("items")).collect()}
        if not before:
            break
        most = max(v[1] for v in before.values())
        again = cut(_deal(loose.select("pack_id", "capacity", "doc_id", "piece_no", "tokens"), max(1, -(-most // ITEMS)), r).withColumn("round", F.lit(r)))
        after = {x.pack_id: x.bins for x in again.groupBy("pack_id").agg(F.count_distinct("part", "bin").alias("bins")).collect()}
        better = [k for k, v in after.items() if v < before[k][0]]
        if not better:
            continue  # another seed opens other containers
        chosen = F.col("pack_id").isin(better)
        done = cut(done.where(~(gap & chosen)).unionByName(again.where(chosen)))
    return done.select("pack_id", name.alias("bin_id"), "doc_id", "piece_no", "tokens").unionByName(full)


def token_sizes(documents: DataFrame) -> DataFrame:
    return cut(documents.select(F.col("doc_id"), token_count("text").alias("tokens")))


def report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container kind: items, tokens, containers used, lower bound, and the share of space filled."""
    used = packed.groupBy("pack_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.count_distinct(F.when(F.col("tokens") > 0, F.col("bin_id"))).alias("n_bins"))
    hist = packed.groupBy("pack_id", "tokens").agg(F.count("*").alias("k"))
    spec = specs.select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("int").alias("capacity"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per size: at most a capacity's worth of rows
        c = int(pdf["capacity"].iloc[0])
        count = np.zeros(c + 1, dtype=np.int64)
        np.add.at(count, pdf["tokens"].to_numpy(dtype=np.int64), pdf["k"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"pack_id": [int(pdf["pack_id"].iloc[0])], "lower_bound": [lower_bound_of(count, c)]})

    bounds = hist.join(F.broadcast(spec), "pack_id").groupBy("pack_id").applyInPandas(bound, "pack_id int, lower_bound bigint")
    return used.join(bounds, "pack_id").join(F.broadcast(spec), "pack_id").select("pack_id", "capacity", "n_items", "n_tokens", "n_bins", "lower_bound", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"))
