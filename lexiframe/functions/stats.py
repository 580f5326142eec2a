"""Order statistics. The rules differ on purpose and aren't interchangeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(x: Column) -> Column:
    """Mean of the middle two."""
    return F.median(x)


def upper_median(sorted_values: Column) -> Column:
    """Element n // 2 of a sorted array, counting from 0; null if empty."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def at_share(sorted_values: Column, q: float) -> Column:
    """Element min(int(n q), n - 1) of a sorted array."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * F.lit(q)).cast("int"), n - 1))


def decile(sorted_values: Column, k: int) -> Column:
    """Element n k // 10 of a sorted array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * k / 10).cast("int"))


def linear_percentile(x: Column, q: float) -> Column:
    """Linear interpolation between the neighbours."""
    return F.percentile(x, q)


def bootstrap_bound(sorted_values: Column, q: float) -> Column:
    """Element int(q R) of R sorted draws."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * F.lit(q)).cast("int"))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per group with the elements of its sorted values at ranks (from 0), which may depend on the group's size, column n.

    Nothing is sorted as a whole: values are counted, whole units of the value (floor) are summed up first, and only the units in which
    a rank ends are sorted. Null and NaN values are left out.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    units = counts.groupBy(*by, F.floor("_v").alias("_u")).agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
    hits = units.withColumn("_r", F.filter(wanted, lambda x: (x["rank"] >= F.col("_base")) & (x["rank"] < F.col("_base") + F.col("_c")))).where(F.size("_r") > 0)
    inside = counts.withColumn("_u", F.floor("_v")).join(hits.select(*by, "_u", "_base", "_r", "n"), [*by, "_u"])
    upto = F.col("_base") + F.sum("_c").over(Window.partitionBy(*by, "_u").orderBy("_v"))
    got = inside.withColumn("_upto", upto).select(*by, "n", "_v", F.explode(F.filter("_r", lambda x: (x["rank"] < F.col("_upto")) & (x["rank"] >= F.col("_upto") - F.col("_c")))).alias("_x"))
    return got.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_x.name") == k, F.col("_v"))).alias(k) for k in ranks])


def python_round(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value, as Python rounds: the product with the power of ten is taken with its rounding error, which
    splitting the factor in two halves makes exact. For values below 10^11 and up to four digits."""
    p = F.lit(float(10**digits))
    high = x * 134217729.0 - (x * 134217729.0 - x)
    hi = x * p
    lo = (high * p - hi) + (x - high) * p
    whole = F.floor(hi).cast("double")
    rest = hi - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lo > 0) | ((lo == 0) & (F.pmod(whole, F.lit(2.0)) == 1.0))))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / p


def realtime_factor(seconds: Column, processing: Column) -> Column:
    """Seconds of audio per second of processing; null where none passed."""
    return F.try_divide(seconds, F.when(processing > 0, processing))


def percent(flag: Column) -> Column:
    """Share of the rows of a group where the flag holds, in percent; 0 of no rows. Null counts as not."""
    return 100.0 * F.count_if(flag) / F.greatest(F.count("*"), F.lit(1))


def ratio_of_sums(a: Column, b: Column, least: float = 1.0) -> Column:
    """Sum of a over the sum of b, which counts as `least` at least."""
    return F.sum(a) / F.greatest(F.sum(b), F.lit(least))
