"""Contracts between data sets; a broken one raises before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """A data contract is broken."""


def _none(df: DataFrame, what: str) -> None:
    rows = df.limit(5).collect()
    if rows:
        raise ContractViolation(f"{what}: {[tuple(r) for r in rows]}")


def disjoint(a: DataFrame, b: DataFrame, cols: list[str], what: str = "sets share keys") -> None:
    known = " and ".join(f"{c} is not null" for c in cols)
    _none(a.select(*cols).where(known).join(b.select(*cols).where(known).distinct(), cols, "left_semi").distinct(), what)


def subset(a: DataFrame, b: DataFrame, cols: list[str], what: str = "keys are missing") -> None:
    _none(a.select(*cols).join(b.select(*cols).distinct(), cols, "left_anti").distinct(), what)


def unique(df: DataFrame, cols: list[str], what: str = "keys repeat") -> None:
    _none(df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1"), what)


def row_count(df: DataFrame, expected: int, what: str = "rows") -> None:
    n = df.count()
    if n != expected:
        raise ContractViolation(f"{what}: {n}, expected {expected}")


def scored_enough(rows: int, scored: int, least: float = 0.5) -> None:
    if rows == 0 or scored / rows < least:
        raise ContractViolation(f"only {scored} of {rows} rows are scored")


def same_options(run: dict, contract: dict) -> None:
    """Options of a run must equal the contract's, key by key."""
    differ = {k: (run.get(k), v) for k, v in contract.items() if run.get(k) != v}
    if differ:
        raise ContractViolation(f"options differ: {differ}")


def no_text_leak(dev: DataFrame, train: DataFrame, text: str = "sentence", min_chars: int = 61) -> None:
    a = dev.where(F.char_length(text) >= min_chars).select(text)
    _none(a.join(train.select(text).distinct(), text, "left_semi"), "texts stand on both sides")
