"""Comparison of two runs: outcomes, paired and clustered bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bootstrap_bound
from ..functions.text import hashed_rank


def matched(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Full outer match with side: both, only_a or only_b."""
    x = a.select(key, F.col("errors").alias("a_errors"), F.col("ref_words").alias("a_words"))
    y = b.select(key, F.col("errors").alias("b_errors"), F.col("ref_words").alias("b_words"))
    return x.join(y, key, "full_outer").withColumn("side", F.when(F.col("b_words").isNull(), "only_a").when(F.col("a_words").isNull(), "only_b").otherwise("both"))


def outcomes(both: DataFrame) -> DataFrame:
    return both.where("side = 'both'").agg(F.count_if(F.col("b_errors") < F.col("a_errors")).alias("better"), F.count_if(F.col("b_errors") > F.col("a_errors")).alias("worse"), F.count_if(F.col("b_errors") == F.col("a_errors")).alias("equal"))


def numbered(df: DataFrame, key: str, bins: int = 1024) -> DataFrame:
    """Adds i, from 0 by the hash of the key: a bin of hashes gets an offset, and rows are ranked in their bin only."""
    h = hashed_rank(F.col(key), 0)
    d = df.withColumn("_h", h).withColumn("_b", F.floor(h / ((1 << 32) // bins)).cast("int"))
    sizes = d.groupBy("_b").agg(F.count("*").alias("_n"))
    base = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # at most `bins` rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return d.withColumn("_r", rank).join(F.broadcast(base), "_b").withColumn("i", (F.col("_base") + F.col("_r")).cast("int")).drop("_h", "_b", "_r", "_base")


def bootstrap_draws(units: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(round, diff): difference of the error rates b - a in each round of draws with replacement over units.

    units: (unit, words, a_errors, b_errors); a unit is a sample or, for the clustered form, a call. Draw k of round r is the unit at
    md5(seed | r | k) modulo the number of units, so that any engine draws the same; units are numbered in the order of their own md5. The
    units are few columns wide and are joined by their index; the draws are summed as they are made.
    """
    spark = units.sparkSession
    n = units.count()
    indexed = numbered(units, "unit")
    draws = spark.range(rounds * n).select(F.floor(F.col("id") / n).alias("round"), (F.col("id") % n).alias("k"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.select("round", (h % n).cast("int").alias("i")).groupBy("round", "i").agg(F.count("*").alias("c"))
    got = draws.join(indexed, "i").groupBy("round").agg(F.sum(F.col("c") * F.col("a_errors")).alias("a"), F.sum(F.col("c") * F.col("b_errors")).alias("b"), F.sum(F.col("c") * F.col("words")).alias("w"))
    return got.select("round", ((F.col("b") - F.col("a")).cast("double") / F.col("w")).alias("diff"))


def bootstrap_summary(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """lo, hi, p and the verdict by the sign of the interval. One value per round: the array is as long as the rounds are many."""
    tail = (1 - level) / 2
    d = draws.agg(F.sort_array(F.collect_list("diff")).alias("d"))
    below = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + F.when(x <= 0, 1.0).otherwise(0.0)) / F.size("d")
    above = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + F.when(x >= 0, 1.0).otherwise(0.0)) / F.size("d")
    out = d.select(bootstrap_bound(F.col("d"), tail).alias("lo"), bootstrap_bound(F.col("d"), 1 - tail).alias("hi"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))
    return out.withColumn("verdict", F.when(F.col("hi") < 0, "better").when(F.col("lo") > 0, "worse").otherwise("not reliable"))


def run_difference(runs: DataFrame, run: str = "run_id", value: str = "wer") -> DataFrame:
    """(run_a, run_b, difference, verdict) of exactly two runs by name: b - a in percentage points, better if b is lower. Any other number
    of runs gives no row."""
    d = runs.agg(F.count("*").alias("_n"), F.min(F.struct(run, value)).alias("a"), F.max(F.struct(run, value)).alias("b")).where("_n = 2")
    diff = (F.col(f"b.{value}") - F.col(f"a.{value}")) * 100
    return d.select(F.col(f"a.{run}").alias("run_a"), F.col(f"b.{run}").alias("run_b"), diff.alias("difference"), F.when(diff < 0, "better").when(diff > 0, "worse").otherwise("equal").alias("verdict"))


def old_and_new(new: DataFrame, old: DataFrame, key: str = "call_id") -> DataFrame:
    """One row over the calls that both sides score: calls, new_wer (ratio of sums of errors and ref_words) and old_wer (mean of the calls'
    rates). The two aren't the same measure; they are shown side by side as they were published."""
    n = new.groupBy(key).agg(F.sum("errors").alias("e"), F.sum("ref_words").alias("w")).where("w > 0")
    both = n.join(old.select(key, F.col("wer").alias("_o")), key)
    return both.agg(F.count("*").alias("calls"), F.try_divide(F.sum("e").cast("double"), F.sum("w")).alias("new_wer"), F.avg("_o").alias("old_wer"))


def seen_flag(rows: DataFrame, history: list[DataFrame], text: str = "sentence") -> DataFrame:
    """Marks rows whose text stands in any earlier training set."""
    past = history[0].select(text)
    for h in history[1:]:
        past = past.union(h.select(text))
    return rows.join(past.where(F.col(text).isNotNull()).distinct().withColumn("seen", F.lit(True)), text, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
