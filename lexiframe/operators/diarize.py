"""Words to speakers, segments, roles and voice profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_turn(words: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """words (key, pos, start, end, word) with the speaker of the turn (key, turn_pos, start, end, speaker) nearest to the word's middle:
    distance 0 inside, else to the nearer edge; the first turn wins ties. A minimum aggregate over the key's turns, which a call bounds."""
    t = turns.select(key, F.col("turn_pos"), F.col("start").alias("_s"), F.col("end").alias("_e"), "speaker")
    d = words.join(t, key)
    mid = (F.col("start") + F.col("end")) / 2
    dist = F.when((mid >= F.col("_s")) & (mid <= F.col("_e")), 0.0).otherwise(F.least(F.abs(mid - F.col("_s")), F.abs(mid - F.col("_e"))))
    return d.groupBy(key, "pos", "start", "end", "word").agg(F.min_by("speaker", F.struct(dist.alias("d"), "turn_pos")).alias("speaker"))


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds island: a number that rises whenever value changes along the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segments(words: DataFrame, key: str) -> DataFrame:
    """Neighbouring words of one speaker as (key, island, speaker, start, end, text, n_words)."""
    d = islands(words, [key], ["pos"], "speaker")
    row = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return d.groupBy(key, "island", "speaker").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(row, " ").alias("text"), F.count("*").alias("n_words"))


def filled_roles(df: DataFrame, key: list[str], order: list[str], role: str) -> Column:
    """The last known role along the order; before the first known one, that one."""
    w = Window.partitionBy(*key).orderBy(*order)
    back = F.last(role, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(role, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def role_tags(df: DataFrame, key: list[str], order: list[str], role: str, text: str) -> DataFrame:
    """Adds tagged: the text with its role in front where the role changes."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = ~F.lag(role).over(w).eqNullSafe(F.col(role)) | (F.row_number().over(w) == 1)
    tag = F.concat(F.lit("["), F.upper(F.coalesce(F.col(role), F.lit("?"))), F.lit("] "))
    return df.withColumn("tagged", F.when(change, F.concat(tag, F.col(text))).otherwise(F.col(text)))


def first_speaker(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by("speaker", "pos").alias("speaker"))


def renamed(df: DataFrame, key: str) -> DataFrame:
    """Adds label: Speaker 1..n by first appearance."""
    first = df.groupBy(key, "speaker").agg(F.min("pos").alias("_p"))
    named = first.select(key, "speaker", F.concat(F.lit("Speaker "), F.row_number().over(Window.partitionBy(key).orderBy("_p")).cast("string")).alias("label"))
    return df.join(named, [key, "speaker"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 in place of a zero norm."""
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, n): element-wise mean, summed per position so that no group is gathered."""
    d = df.select(group, F.posexplode_outer(vector).alias("i", "x")).where("i is not null")
    m = d.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"), F.max("n").alias("n"))


def voice_profiles(df: DataFrame, group: str, call: str, vector: str, rounds: int = 3, sample: int = 512) -> DataFrame:
    """(group, profile, n calls): of each group's vectors (one or more per call), the one with the greatest sum of best cosines to the
    group's calls, refined by means of each call's unit vector nearest to it.

    The first choice compares vectors with each other and is made among `sample` vectors of a group, by hash; the refinement covers all of
    them by aggregates. Null vectors are left out.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(["call", "h"])["v"].tolist(), float)
        code = np.unique(pdf.sort_values(["call", "h"])["call"].to_numpy(), return_inverse=True)[1]
        sim = x @ x.T
        best = np.stack([sim[:, code == c].max(axis=1) for c in range(code.max() + 1)], axis=1)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "p": [x[int(best.sum(axis=1).argmax())].tolist()]})

    kind = df.schema[group].dataType.simpleString()
    d = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(call).alias("call"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-9))
    d = d.withColumn("l", norm).withColumn("v", F.transform("v", lambda x: x / F.col("l"))).drop("l").withColumn("h", F.xxhash64("v"))
    few = d.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("k") <= sample).drop("k")
    profile = few.groupBy("g").applyInPandas(choose, f"g {kind}, p array<double>")
    for _ in range(rounds):
        near = d.join(profile, "g").groupBy("g", "call").agg(F.max_by("v", F.struct(dot(F.col("v"), F.col("p")).alias("s"), "h")).alias("v"))
        mean = centroids(near, "g", "v").withColumn("l", F.greatest(F.sqrt(dot(F.col("centroid"), F.col("centroid"))), F.lit(1e-9)))
        profile = mean.select("g", F.transform("centroid", lambda x: x / F.col("l")).alias("p"))
    n = d.groupBy("g").agg(F.count_distinct("call").alias("n"))
    return profile.join(n, "g").select(F.col("g").alias(group), F.col("p").alias("profile"), "n")


def decided_roles(df: DataFrame, similarity: str, call: str, threshold: float = 0.35) -> DataFrame:
    """The speaker of a call most like the seller's profile is the seller if the similarity reaches the threshold; else the role is
    unknown."""
    return df.groupBy(call).agg(F.max_by("speaker", similarity).alias("speaker"), F.max(similarity).alias("similarity")).withColumn("role", F.when(F.col("similarity") >= threshold, "sotuvchi").otherwise("nomalum"))
