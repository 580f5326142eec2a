"""Weighted training sets: scores joined to samples, worst labels cut, hard examples repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import at_ranks


def with_scores(samples: DataFrame, by_path: DataFrame, by_call: DataFrame | None = None) -> DataFrame:
    """samples with wer: by path, else by call; null if unscored."""
    d = samples.join(by_path.select("path", F.col("wer").alias("_p")), "path", "left")
    if by_call is None:
        return d.withColumnRenamed("_p", "wer")
    d = d.join(by_call.select("call_id", F.col("wer").alias("_c")), "call_id", "left")
    return d.withColumn("wer", F.coalesce("_p", "_c")).drop("_p", "_c")


def cutoff(scored: DataFrame, wer: str = "wer", share: float = 0.95) -> float | None:
    """Element int(share n) of the sorted rates. Only the thousandth in which it lies is sorted."""
    d = scored.select((F.col(wer) * 1000).alias("m"), F.lit(0).alias("g"))
    got = at_ranks(d, ["g"], "m", {"at": F.least(F.floor(F.lit(share) * F.col("n")), F.col("n") - 1)}).first()
    if got is None:
        return None
    return scored.where(F.col(wer) * 1000 == F.lit(got["at"])).agg(F.min(wer)).first()[0]


def hours(df: DataFrame, seconds: str, times: Column | None = None) -> DataFrame:
    """One row: rows, hours and, where rows repeat, repeated rows and weighted hours. Unknown durations count as 0."""
    s = F.coalesce(F.col(seconds), F.lit(0.0)).cast("decimal(18,4)")
    k = F.lit(1) if times is None else times
    return df.agg(F.count("*").alias("rows"), F.sum(k).cast("long").alias("repeated_rows"), (F.sum(s).cast("double") / 3600).alias("hours"), (F.sum(s * k).cast("double") / 3600).alias("weighted_hours"))


def repeat_factor(wer: Column) -> Column:
    """1 for unscored or easy samples (below 0.30), 3 for hard ones (0.60 and above), else 2."""
    return F.when(wer.isNull() | (wer < 0.30), 1).when(wer >= 0.60, 3).otherwise(2)


def replicate(df: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, numbered by copy from 1; no row for less than 1."""
    return df.withColumn("copy", F.explode(F.when(times >= 1, F.sequence(F.lit(1), times.cast("int")))))
