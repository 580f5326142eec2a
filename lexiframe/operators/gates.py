"""Quality gates: the first rule that fails names the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Bounds of a sample; all are inclusive."""

    min_seconds: float = 1.2
    max_seconds: float = 30.0
    min_chars: int = 4
    min_cps: float = 6.0
    max_cps: float = 26.0


CALLS = Gate()
CORPUS = Gate(min_seconds=1.0, min_chars=5)


def reason(gate: Gate, seconds: Column, text: Column, first: list[tuple[Column, str]] | None = None, last: list[tuple[Column, str]] | None = None) -> Column:
    """Name of the first failed rule, null if none: the caller's first rules, then long, short, text, cps, then its last rules. An unknown
    duration or text fails as short or text."""
    chars = F.char_length(F.trim(text))
    rules = [
        *(first or []),
        (seconds > gate.max_seconds, "long"),
        (F.coalesce(seconds < gate.min_seconds, F.lit(True)) | F.isnan(seconds), "short"),
        (F.coalesce(chars < gate.min_chars, F.lit(True)), "text"),
        (~(chars.cast("double") / seconds).between(gate.min_cps, gate.max_cps), "cps"),
        *(last or []),
    ]
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for c, name in rules[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def split_by_reason(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with why)."""
    d = df.withColumn("why", why)
    return d.where("why is null").drop("why"), d.where("why is not null")


def pieces_pass(pieces: Column, gate: Gate) -> Column:
    """True if every piece of array<struct<seconds, text>> passes: one bad piece rejects the sample."""

    def ok(p: Column) -> Column:
        n = F.char_length(F.trim(p["text"]))
        return p["seconds"].between(gate.min_seconds, gate.max_seconds) & (n >= gate.min_chars) & (n / p["seconds"]).between(gate.min_cps, gate.max_cps)

    return F.forall(pieces, ok)


def votes_v1(df: DataFrame, up: str = "up_votes", down: str = "down_votes") -> DataFrame:
    """Rows with an up vote and no down vote; all rows if a column is missing."""
    return df.where((F.col(up) >= 1) & (F.col(down) == 0)) if {up, down} <= set(df.columns) else df


def votes_v2(df: DataFrame, up: str | None, down: str | None, least: int = 0) -> DataFrame:
    """Rows whose up votes less down votes reach `least`; votes that are no numbers keep the row."""

    def n(c: str | None) -> Column:
        return F.lit(0) if c is None else F.when(F.col(c).isNull(), 0).otherwise(F.col(c).cast("string").try_cast("int"))

    return df.where(F.coalesce(n(up) - n(down) >= least, F.lit(True)))
