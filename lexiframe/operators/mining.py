"""Error mining: confusions, positions, hard examples, domain terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DOMAIN_TERMS


def exploded_ops(counted: DataFrame, keep: list[str]) -> DataFrame:
    """One row per operation that isn't a match, with the number of reference words."""
    d = counted.select(*keep, F.col("ref_words"), F.explode("ops").alias("o"))
    return d.where("o.op != 'eq'").select(*keep, "ref_words", "o.op", "o.ref", "o.hyp", "o.ref_idx")


def confusions(ops: DataFrame) -> DataFrame:
    """Counts of (op, ref, hyp): substituted pairs, deleted and inserted words."""
    return ops.groupBy("op", "ref", "hyp").agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """Top k of each kind of operation; ties by the words."""
    w = Window.partitionBy("op").orderBy(F.desc("n"), F.asc_nulls_first("ref"), F.asc_nulls_first("hyp"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def position_deciles(ops: DataFrame) -> DataFrame:
    """Share of the operations in each tenth of the reference."""
    bin_ = F.least(F.floor(F.col("ref_idx") / F.col("ref_words") * 10), F.lit(9)).cast("int")
    counts = ops.where("ref_words > 0").groupBy(bin_.alias("decile")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def domain_hits(subs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(ref, n) of substituted words that contain a domain term."""
    hit = F.lit(False)
    for t in terms or DOMAIN_TERMS:
        hit = hit | F.contains(F.col("ref"), F.lit(t))
    return subs.where(hit).groupBy("ref").agg(F.sum("n").alias("n"))


def hard_examples(scored: DataFrame, wer: Column, key: str, skip_share: float = 0.05, take: int = 60) -> DataFrame:
    """The `take` rows with the highest error rate behind the top skip_share (at least one row), which is taken for bad labels. Only the
    head of the order is needed, so it is a top-k, not a full sort."""
    n = scored.count()
    skip = max(1, int(skip_share * n))
    top = scored.withColumn("_w", wer).orderBy(F.desc("_w"), key).limit(skip + take)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_w"), key))).where(F.col("rank") > skip).drop("_w")


def duration_buckets(d: Column) -> Column:
    """Length classes of samples in seconds."""
    return F.when(d < 8, "<8").when(d < 15, "8-15").when(d < 22, "15-22").when(d <= 31, "22-31").otherwise(">31")
