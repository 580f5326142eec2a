"""Problem 1: splits that keep related records together.

Method: component swap search. Calls and leads form a graph; its components are the units that may not part. A component starts in the
split that its hash names; chains of annealing then move components or exchange two of them to reduce the deviation of sizes and label
counts from the targets, in parallel over blocks of components, and the best chain of each block stands.

Hot leads: a call's smallest lead stands for the call (a partial aggregate), and only calls with several leads make edges, between
leads. Components are found on those edges by rounds of large-star and small-star, which are joins and minimum aggregates: no group
of edges is ever gathered. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded_rows, drop_durable, durable
from .keys import known_call, known_lead, plain

BLOCK = 20_000  #: components per block of the search
GIANTS = 2_000  #: a component with over 1 / GIANTS of the rows is placed before the blocks; there are at most GIANTS of them
CHAINS = 4
SWEEPS = 6  #: proposals per component and chain
LABEL_WEIGHT = 0.5
POOLS = 8  #: groups of the labels beyond the largest ones
GIANT_STEPS = 20_000


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v: long): root is the smallest node of the component. Self-loops and repeated edges are
    allowed; no edges give no rows."""
    e = durable(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        nxt = durable(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_durable(e)
        e = nxt
        if tuple(state) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct().toDF("node", "root"))
        seen = tuple(state)


def linked_rows(manifest: DataFrame, split: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, components).

    calls: call_key, component. A row without a known call is a call of its own, named by its path.
    components: component, n rows, labels (map of direction to rows), first and last split by name of the rows with one (null without).
    split: the split a row counts for; rows where it is null are left out of everything. Without it all rows take part.
    """
    call = F.coalesce(F.concat(F.lit("c"), known_call(F.col("call_id"), F.col("path")).cast("string")), F.concat(F.lit("p"), F.coalesce("path", F.lit("")))).alias("call_key")
    m = manifest.select(call, known_lead(F.col("lead_id")).alias("lead"), F.coalesce(plain(F.col("direction")), F.lit("?")).alias("label"), (F.lit(None).cast("string") if split is None else split).alias("split"))
    if split is not None:
        m = m.where(F.col("split").isNotNull())
    # partial aggregate: one row per call, lead, label and split
    rows = durable(m.groupBy("call_key", "lead", "label", "split").agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy("call_key").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    several = first.where("low != high")
    edges = rows.join(several, "call_key").where("lead != low").select(F.col("lead").alias("u"), F.col("low").alias("v")).distinct()
    roots = star_components(edges)
    calls = first.join(roots.toDF("low", "root"), "low", "left").select("call_key", F.coalesce(F.concat(F.lit("l"), F.coalesce("root", "low").cast("string")), "call_key").alias("component"))
    calls = durable(calls, "calls")
    per_call = rows.groupBy("call_key", "label").agg(F.sum("n").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    per = per_call.join(calls, "call_key").groupBy("component", "label").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    comps = durable(per.groupBy("component").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"), F.min("lo").alias("first_split"), F.max("hi").alias("last_split")), "components")
    return calls, comps


def anneal(sizes: np.ndarray, start: np.ndarray, target: np.ndarray, weights: np.ndarray, seed: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """Swap search over one block: sizes[i, k] counts component i's rows in total (k = 0) and by label; target[s, k] is wanted. Returns
    the best assignment met and its energy, the weighted absolute deviation."""
    rng = np.random.default_rng(seed)
    n, parts = len(sizes), len(target)
    at = start.copy()
    have = np.zeros_like(target)
    np.add.at(have, at, sizes)
    gap = have - target
    energy = float((np.abs(gap) * weights).sum())
    best, best_at = energy, at.copy()
    steps = sweeps * n
    if not steps or parts < 2:
        return best_at, best
    heat = max(energy / max(n, 1), 1e-9)
    pick, other, to, kind, luck = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, parts, steps), rng.random(steps), rng.random(steps)
    for k in range(steps):
        i, a = pick[k], at[pick[k]]
        if kind[k] < 0.5:
            j, b, d = -1, to[k], sizes[i]
        else:
            j = other[k]
            b, d = at[j], sizes[i] - sizes[j]
        if a == b:
            continue
        ga, gb = gap[a] - d, gap[b] + d
        change = float(((np.abs(ga) - np.abs(gap[a]) + np.abs(gb) - np.abs(gap[b])) * weights).sum())
        if change <= 0 or luck[k] < np.exp(-change / (heat * (1 - k / steps) + 1e-12)):
            gap[a], gap[b] = ga, gb
            at[i] = b
            if j >= 0:
                at[j] = a
            energy += change
            if energy < best - 1e-9:
                best, best_at = energy, at.copy()
    return best_at, best


def component_splits(comps: DataFrame, targets: list[tuple[str, float]], seed: int = 0, max_labels: int = 64) -> DataFrame:
    """(component, split, n, first_split, last_split): every component with the split that the swap search gives it.

    targets: (split, share); shares are scaled to sum to 1. Components are blocked by hash, so that each block is a fair draw and gets
    its share of each target. No components give no rows.
    """
    total = comps.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    schema = "component string, split string, n long, first_split string, last_split string"
    spark = comps.sparkSession
    if not total["k"]:
        return spark.createDataFrame([], schema)
    labels = comps.select(F.explode("labels").alias("label", "c")).groupBy("label").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "label").limit(max_labels).collect()
    names = [r["label"] for r in labels]
    others = F.map_filter("labels", lambda k, _: ~k.isin(names))
    rest = comps.select(F.explode_outer(others).alias("label", "m")) if len(names) == max_labels else None
    # labels beyond the largest count together, in hashed groups
    pooled = [0] * POOLS
    if rest is not None:
        for r in rest.where("label is not null").groupBy(F.pmod(F.xxhash64("label"), F.lit(POOLS)).alias("b")).agg(F.sum("m").alias("c")).collect():
            pooled[r["b"]] = r["c"]
    pools = [b for b in range(POOLS) if pooled[b]]

    def pool(b: int) -> Column:
        mine = F.map_filter("labels", lambda k, _: ~k.isin(names) & (F.pmod(F.xxhash64(k), F.lit(POOLS)) == b))
        return F.aggregate(F.map_values(mine), F.lit(0).cast("long"), lambda acc, x: acc + x).cast("double")

    share = np.array([max(0.0, s) for _, s in targets], float)
    share = share / share.sum()
    splits = [s for s, _ in targets]
    sums = np.array([total["n"], *[r["c"] for r in labels], *[pooled[b] for b in pools]], float)
    weights = np.array([1.0, *[LABEL_WEIGHT] * (len(names) + len(pools))])
    bound = total["n"] / GIANTS
    vec = F.array(F.col("n").cast("double"), *[F.coalesce(F.col("labels")[x], F.lit(0)).cast("double") for x in names], *[pool(b) for b in pools])
    c = comps.select("component", "n", vec.alias("v"), F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(1 << 40)).alias("h"))

    def hashed(h: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(share)[:-1], (h / float(1 << 40)), side="right")

    giants = c.where(F.col("n") > bound).orderBy("component").collect()  # fewer than GIANTS by construction
    target = np.outer(share, sums)
    placed: dict[str, int] = {}
    small_sums = sums.copy()
    if giants:
        g = np.array([r["v"] for r in giants], float)
        small_sums = sums - g.sum(0)
        # the same search over all of them, from the hash; what they leave is the target of the blocks
        own = target * (g.sum(0) / np.maximum(sums, 1e-9))
        tries = [anneal(g, hashed(np.array([r["h"] for r in giants])), own, weights, seed + k, max(SWEEPS, GIANT_STEPS // len(g))) for k in range(CHAINS)]
        at, _ = min(tries, key=lambda t: t[1])
        placed = {r["component"]: int(s) for r, s in zip(giants, at, strict=True)}
        taken = np.zeros_like(target)
        np.add.at(taken, at, g)
        target = np.maximum(target - taken, 0)
        target = target * (small_sums / np.maximum(target.sum(0), 1e-9))
    blocks = max(1, -(-int(total["k"]) // BLOCK))
    small = c.where(F.col("n") <= bound).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    small = small.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(CHAINS - 1))))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", ignore_index=True)
        v = np.array(pdf["v"].tolist(), float).reshape(len(pdf), len(sums))
        mine = target * (v.sum(0) / np.maximum(small_sums, 1e-9))
        at, energy = anneal(v, hashed(pdf["h"].to_numpy()), mine, weights, seed * 1000 + int(key[0]) * CHAINS + int(key[1]))
        out = pdf[["component", "block", "chain"]].copy()
        out["split"] = [splits[i] for i in at]
        out["energy"] = energy
        return out

    tried = small.groupBy("block", "chain").applyInPandas(search, "component string, block int, chain int, split string, energy double")
    tried = durable(tried, "chains")
    best = tried.groupBy("block").agg(F.min(F.struct("energy", "chain")).alias("b")).select("block", F.col("b.chain").alias("chain"))
    out = tried.join(best, ["block", "chain"], "left_semi").select("component", "split")
    if giants:
        out = out.union(spark.createDataFrame([(r["component"], splits[placed[r["component"]]]) for r in giants], "component string, split string"))
    return out.join(comps.select("component", "n", "first_split", "last_split"), "component").select("component", "split", "n", "first_split", "last_split")


def read_targets(targets: DataFrame) -> list[tuple[str, float]]:
    """(split, share) of a table (split, percent)."""
    return [(r["split"], r["percent"] / 100) for r in sorted(bounded_rows(targets, 100, "split_targets"), key=lambda r: r["split"]) if r["split"] and r["percent"]]


def parted_calls(manifest: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(call_id): the calls whose linked group lies in more than one split today. The groups and their splits come from the search's
    result, which carries what a component held before; rows without one of the splits take no part."""
    wanted = read_targets(targets)
    now = plain(F.col("split"))
    calls, comps = linked_rows(manifest, F.when(now.isin([s for s, _ in wanted]), now))
    plan = component_splits(comps, wanted, seed)
    parted = plan.where("first_split != last_split").select("component")
    return calls.join(parted, "component", "left_semi").where(F.col("call_key").startswith("c")).select(F.expr("cast(substring(call_key, 2) as bigint)").alias("call_id"))


def assign_splits(manifest: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """manifest's path and call with the component and the split the search assigns, one row per manifest row (repeats stay). Null calls
    are read from the path; a row with neither call nor lead is a component of its own path."""
    wanted = read_targets(targets)
    calls, comps = linked_rows(manifest)
    plan = component_splits(comps, wanted, seed)
    by_call = calls.join(plan.select("component", "split"), "component")
    call = known_call(F.col("call_id"), F.col("path"))
    key = F.coalesce(F.concat(F.lit("c"), call.cast("string")), F.concat(F.lit("p"), F.coalesce("path", F.lit(""))))
    rows = manifest.select("path", call.alias("call_id"), key.alias("call_key"))
    return rows.join(by_call, "call_key").select("path", "call_id", "component", "split")
