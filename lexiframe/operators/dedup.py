"""First occurrences and part-or-whole choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order. A minimum over structs: partial aggregates keep one row per key and task, so that a key with
    many rows makes no large group."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest] if c not in key]).select(*df.columns)


def prefer_parts(df: DataFrame, key: str = "call_id", part: str = "part") -> DataFrame:
    """Drops a key's whole rows (part null) if it has parts."""
    has = df.groupBy(key).agg(F.max(F.col(part).isNotNull()).alias("_has"))
    return df.join(has.where("_has").select(key), key, "left_semi").where(F.col(part).isNotNull()).unionByName(df.join(has.where("_has").select(key), key, "left_anti"))
