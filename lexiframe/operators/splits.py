"""Splits and samples by group; every draw is ordered by an md5 that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_rank


def split_by_group(df: DataFrame, group: str, dev_share: float, seed: int, least: int = 1) -> DataFrame:
    """Adds split: the first max(least, round(n share)) groups by hash are dev, all else train. The cut is found by a top-k over the
    distinct groups; rows get their split by comparing with the cut, without a join."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    n = groups.count()
    take = min(n, max(least, int(n * dev_share + 0.5)))
    h = hashed_rank(F.col(group), seed)
    if not n or not take:
        return df.withColumn("split", F.lit("train"))
    last = groups.select(h.alias("h"), F.col(group).alias("g")).orderBy("h", "g").limit(take).agg(F.max(F.struct("h", "g")).alias("m")).first()["m"]
    is_dev = (h < last["h"]) | ((h == last["h"]) & (F.col(group) <= last["g"]))
    return df.withColumn("split", F.when(F.coalesce(is_dev, F.lit(False)), "dev").otherwise("train"))


FILL_BINS = 4096


def capped_fill(df: DataFrame, group: str, seconds: Column, share: float, seed: int, cap: float = 0.03, overshoot: float = 1.08) -> DataFrame:
    """Adds split: groups in hash order go to dev until its share of the seconds is reached; groups above cap of the total are skipped, as
    is one that would overshoot. As long as no group can overshoot, whole bins of the hash go to dev by their sums; only the groups
    behind them are folded one by one on the driver, and those chosen there are sent back."""
    per = df.groupBy(group).agg(F.sum(F.coalesce(seconds, F.lit(0.0)).cast("decimal(20,6)")).cast("double").alias("s"))
    total = per.agg(F.sum("s")).first()[0] or 0.0
    target = total * share
    h = hashed_rank(F.col(group), seed)
    width = (1 << 32) // FILL_BINS
    small = per.where(F.col("s") <= cap * total).withColumn("h", h).withColumn("bin", F.floor(F.col("h") / width).cast("int"))
    bins = sorted(small.groupBy("bin").agg(F.sum("s").alias("s"), F.max("s").alias("top")).collect())  # at most FILL_BINS rows
    top = max((r["top"] for r in bins), default=0.0)
    have, first = 0.0, 0
    for r in bins:
        if have + r["s"] > min(target, target * overshoot - top):
            break
        have += r["s"]
        first = r["bin"] + 1
    chosen = []
    for r in small.where(F.col("bin") >= first).orderBy("h", group).toLocalIterator():
        if have >= target:
            break
        if have + r["s"] <= target * overshoot:
            chosen.append(r[group])
            have += r["s"]
    kind = df.schema[group].dataType.simpleString()
    large = per.where(F.col("s") > cap * total).select(group, F.lit(False).alias("_dev"))
    picked = large.union(df.sparkSession.createDataFrame([(x, True) for x in chosen], f"{group} {kind}, _dev boolean"))
    in_bins = F.floor(h / width) < first
    return df.join(picked, group, "left").withColumn("split", F.when(F.coalesce("_dev", in_bins), "dev").otherwise("train")).drop("_dev")


def largest_remainder(strata: DataFrame, n_col: str, need: int, key: list[str]) -> DataFrame:
    """Adds quota: need shared in proportion to n_col, rounded down, the rest to the largest remainders (ties by key, descending)."""
    every = Window.partitionBy()
    exact = F.lit(need) * F.col(n_col) / F.sum(n_col).over(every)
    d = strata.withColumn("_e", exact).withColumn("_q", F.floor("_e")).withColumn("_f", F.col("_e") - F.col("_q"))
    rank = F.row_number().over(Window.orderBy(F.desc("_f"), *[F.desc(k) for k in key]))
    left = F.lit(need) - F.sum("_q").over(every)
    return d.withColumn("quota", (F.col("_q") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_e", "_q", "_f")


def rounded_goals(strata: DataFrame, n_col: str, total: int, key: list[str]) -> DataFrame:
    """Adds goal: shares rounded half to even, the difference to the largest stratum."""
    every = Window.partitionBy()
    d = strata.withColumn("goal", F.rint(F.lit(total) * F.col(n_col) / F.sum(n_col).over(every)).cast("long"))
    first = F.row_number().over(Window.orderBy(F.desc(n_col), *key)) == 1
    return d.withColumn("goal", F.col("goal") + F.when(first, F.lit(total) - F.sum("goal").over(every)).otherwise(0))


def systematic(df: DataFrame, stratum: list[str], order: list[str], n: Column) -> DataFrame:
    """n rows of each stratum at equal spacing of the order: places int(i step + step / 2), step = size / n."""
    w = Window.partitionBy(*stratum)
    d = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_t", F.least(n, F.col("_n")))
    step = F.col("_n") / F.col("_t")
    i = F.ceil((F.col("_k") - step / 2) / step)  # the only i whose place can be k
    hit = (F.col("_t") > 0) & (i >= 0) & (i < F.col("_t")) & (F.floor(i * step + step / 2) == F.col("_k"))
    return d.where(F.coalesce(hit, F.lit(False))).drop("_k", "_n", "_t")


def quartile(df: DataFrame, stratum: list[str], order: list[str]) -> DataFrame:
    """Adds quartile 0..3 of the order with size // 4 rows each; the remainder, at most three, gets null."""
    w = Window.partitionBy(*stratum)
    d = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_q", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 4)))
    q = F.floor(F.col("_k") / F.col("_q"))
    return d.withColumn("quartile", F.when(q < 4, q.cast("int"))).drop("_k", "_q")


def fresh_leads_first(df: DataFrame, stratum: list[str], lead: str, key: str, seed: int) -> DataFrame:
    """Adds pick: the order of draws of a stratum; a lead's first call by hash comes before any second one."""
    h = hashed_rank(F.col(key), seed)
    d = df.withColumn("_h", h)
    again = F.row_number().over(Window.partitionBy(*stratum, lead).orderBy("_h", key)) > 1
    again = F.when(F.col(lead).isNull(), False).otherwise(again)
    d = d.withColumn("_again", again)
    return d.withColumn("pick", F.row_number().over(Window.partitionBy(*stratum).orderBy("_again", "_h", key))).drop("_h", "_again")


def stratified_with_locked(calls: DataFrame, stratum: list[str], total: int, seed: int, key: str = "call_id", lead: str = "lead_id", seconds: str = "duration") -> DataFrame:
    """Sample with all locked calls: each stratum gets its goal less its locked ones, spread over duration quartiles and fresh leads first.
    Locked calls are never trimmed, so the sample exceeds the total if a stratum holds more of them than its goal."""
    goals = rounded_goals(calls.groupBy(*stratum).agg(F.count("*").alias("_size"), F.count_if("locked").alias("_have")), "_size", total, stratum)
    free = quartile(calls.where("not locked"), stratum, [seconds, key])
    free = free.withColumn("quartile", F.coalesce("quartile", F.lit(4)))
    free = fresh_leads_first(free, [*stratum, "quartile"], lead, key, seed)
    order = F.row_number().over(Window.partitionBy(*stratum).orderBy(F.col("quartile") == 4, "pick", "quartile", key))
    free = free.withColumn("_o", order).join(F.broadcast(goals.select(*stratum, (F.col("goal") - F.col("_have")).alias("_need"))), stratum)
    chosen = free.where("_o <= _need").select(*calls.columns)
    return chosen.unionByName(calls.where("locked").select(*calls.columns))


def random_rows(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds split by row: dev where the hash is below the share."""
    return df.withColumn("split", F.when(hashed_rank(F.col(key), seed) < int(share * (1 << 32)), "dev").otherwise("train"))


def round_robin(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows taken from the groups in turn: first rows of all groups, then second ones."""
    d = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return d.where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
