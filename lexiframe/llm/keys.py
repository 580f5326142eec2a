"""Columns of the project's tables as the problems read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_call(call_id: Column, path: Column) -> Column:
    """call_id, or the leading digits of the file name if it is null; null if neither tells it."""
    return F.coalesce(call_id, F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^(\d+)", 1), F.lit("")).try_cast("long"))


def known_lead(lead_id: Column) -> Column:
    """lead_id, null if unknown (null or 0)."""
    return F.nullif(lead_id, F.lit(0).cast("long"))


def plain(c: Column) -> Column:
    """Small letters without outer blanks; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), F.lit(""))


def known_seconds(c: Column) -> Column:
    """A duration; null if unknown (null, NaN, infinite, 0 or negative)."""
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)
