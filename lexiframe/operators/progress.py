"""Series of a training run: early stop, cost projection, checkpoints, label length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def early_stop(steps: DataFrame, run: str, step: str, loss: str, patience: int) -> DataFrame:
    """(run, stop_step): the first step by which `patience` evaluations in a row brought no new least loss; null if none. Null losses are
    no evaluations. A run's evaluations meet in one task; they are a few hundred."""
    w = Window.partitionBy(run).orderBy(step)
    d = steps.where(F.col(loss).isNotNull()).withColumn("_best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.coalesce(F.col(loss) < F.col("_best"), F.lit(True))).withColumn("_k", F.row_number().over(w))
    d = d.withColumn("_since", F.col("_k") - F.max(F.when(F.col("_new"), F.col("_k"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(step))).alias("stop_step"))


def projected_seconds(done: Column, elapsed: Column, total: Column) -> Column:
    """Seconds of a whole run at the pace so far; null before the first step."""
    return F.try_divide(elapsed * total, done)


def best_checkpoint(states: DataFrame, run: str, path: str, best: str) -> DataFrame:
    """(run, checkpoint): the best checkpoint that the newest state names, or the newest state's own path if it names none. Newest is the
    greatest number behind 'checkpoint-' in the path; paths without one come last."""
    n = F.coalesce(F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)", 1), F.lit("")).try_cast("long"), F.lit(-1).cast("long"))
    return states.groupBy(run).agg(F.max_by(F.coalesce(best, path), F.struct(n.alias("n"), F.col(path).alias("p"))).alias("checkpoint"))


def within_labels(df: DataFrame, tokens: Column, most: int = 448) -> DataFrame:
    """Rows whose label has at most `most` tokens; the caller brings the count, unknown ones fall out."""
    return df.where(F.coalesce(tokens <= most, F.lit(False)))
