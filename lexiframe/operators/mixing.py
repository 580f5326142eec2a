"""Ingest of several sources: column resolution, filters, caps, union, oversampling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_text, hashed_rank

# Names of text columns in the order of preference.
TEXT_COLUMNS = ["sentence", "text", "transcription", "normalized_text", "raw_transcription"]


def text_column(df: DataFrame, candidates: list[str] | None = None) -> str | None:
    """The first candidate that the table has."""
    return next((c for c in candidates or TEXT_COLUMNS if c in df.columns), None)


def audio_column(df: DataFrame) -> str | None:
    """The first struct column with bytes, whatever its name."""
    return next((f.name for f in df.schema if isinstance(f.dataType, T.StructType) and "bytes" in f.dataType.names), None)


def vote_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """Columns named like up votes and down votes."""
    find = lambda p: next((c for c in df.columns if re.search(p, c.lower())), None)
    return find(r"up_?vote"), find(r"down_?vote")


def resolved(df: DataFrame, source: str, candidates: list[str] | None = None) -> DataFrame:
    """(source, sentence) of a foreign table: the first text of the candidates it has, rows without text dropped before any cap."""
    have = [c for c in candidates or TEXT_COLUMNS if c in df.columns]
    if not have:
        raise ValueError(f"{source} has none of the text columns")
    return df.select(F.lit(source).alias("source"), first_text([F.col(c) for c in have]).alias("sentence"), *[c for c in df.columns if c not in have and c != "source"]).where("sentence is not null")


def with_audio(df: DataFrame) -> DataFrame:
    """df with its audio column named audio; an error if it has none."""
    c = audio_column(df)
    if c is None:
        raise ValueError("no column holds audio")
    return df.withColumnRenamed(c, "audio")


def union_of(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union of the sources that could be opened, error of each one that couldn't)."""
    frames, failed = [], {}
    for name, load in sources.items():
        try:
            frames.append(resolved(load(), name))
        except Exception as e:  # noqa: BLE001  any kind of failure skips the source
            failed[name] = type(e).__name__
    return (union_sources(frames) if frames else None), failed


def in_order(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Rows in the order of the keys; the first n of them if n is given (a top-k, not a sort of all)."""
    d = df.orderBy(*keys)
    return d if n is None else d.limit(n)


def until_kept(df: DataFrame, order: list[str], keep: Column, n: int, max_scan: int | None = None) -> DataFrame:
    """The first n rows that pass `keep` among the first max_scan rows of the order (of all rows without it)."""
    d = df if max_scan is None else df.orderBy(*order).limit(max_scan)
    return d.where(F.coalesce(keep, F.lit(False))).orderBy(*order).limit(n)


def published(df: DataFrame) -> DataFrame:
    """df without its private columns, those that begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def with_lead(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """df (path, ...) with lead (L<lead>, or C<call> where the lead is unknown) and edited of the manifest; both null for a path it lacks."""
    m = manifest.groupBy("path").agg(F.min("lead_id").alias("_l"), F.min("call_id").alias("_c"), F.max(F.coalesce("claude_edited", F.lit(False))).alias("edited"))
    lead = F.coalesce(F.concat(F.lit("L"), F.col("_l").cast("string")), F.concat(F.lit("C"), F.col("_c").cast("string")))
    return df.join(m.select("path", lead.alias("lead"), "edited"), "path", "left")


def capped(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in a random order that the seed fixes: a top-k by hash."""
    return df.withColumn("_h", hashed_rank(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def oversample_ratio(calls: int, external: int, share: float) -> int:
    """How often call rows repeat so that they make up about `share` of the mix."""
    if calls == 0 or not 0 < share < 1:
        return 1
    return max(1, round(share * external / ((1 - share) * calls)))


def epochs(steps: int, batch: int, accumulation: int, rows: int) -> float:
    return steps * batch * accumulation / max(rows, 1)
