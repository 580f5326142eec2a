"""Error rates of hypotheses against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import align_ops, close_spelling, word_distance
from ..functions.text import APOSTROPHES, raw_words, spell, words


def pair_up(refs: DataFrame, hyps: DataFrame, key: str = "path") -> DataFrame:
    """References with the hypothesis of the same key. Empty references fall out; an empty hypothesis stays and is marked."""
    r = refs.select(key, F.col("sentence").alias("ref_text")).where(F.size(words(F.col("sentence"))) > 0)
    h = hyps.select(key, F.col("text").alias("hyp_text"))
    return r.join(h, key).withColumn("hyp_empty", F.size(words(F.col("hyp_text"))) == 0)


def scores(pairs: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """Adds ref_words, hyp_words and errors of word arrays."""
    return pairs.withColumn("ref_words", F.size(ref).cast("long")).withColumn("hyp_words", F.size(hyp).cast("long")).withColumn("errors", word_distance(ref, hyp).cast("long"))


def error_counts(pairs: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """Adds subs, dels, ins and ops."""
    d = pairs.withColumn("_a", align_ops(ref, hyp))
    return d.select(*pairs.columns, *[F.col(f"_a.{c}").alias(c) for c in ("subs", "dels", "ins", "ops")])


def corpus_wer(scored: DataFrame, by: list[str], fraction: bool = True) -> DataFrame:
    """Ratio of sums: errors, words and wer per group; null where no words are. Not a mean of ratios."""
    e, n = F.sum("errors"), F.sum("ref_words")
    return scored.groupBy(*by).agg(n.alias("ref_words"), e.alias("errors"), F.try_divide(e.cast("double") * (1 if fraction else 100), n).alias("wer"))


def coverage(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.try_divide(F.sum("hyp_words").cast("double"), F.sum("ref_words")).alias("coverage"))


def shares(counted: DataFrame, by: list[str]) -> DataFrame:
    """Sums of each kind of error and its share of all (0 without errors)."""
    total = F.greatest(F.sum(F.col("subs") + F.col("dels") + F.col("ins")), F.lit(1)).cast("double")
    sums = [F.sum(c).cast("long").alias(c) for c in ("subs", "dels", "ins")]
    return counted.groupBy(*by).agg(*sums, *[(F.sum(c) / total).alias(f"{c}_share") for c in ("subs", "dels", "ins")])


def run_wer(runs: DataFrame) -> DataFrame:
    """N runs on one fixed set: (run_id, path, ref_text, hyp_text) -> corpus WER per run; rows with an error are left out by the caller."""
    s = scores(runs, words(F.col("ref_text")), words(F.col("hyp_text")))
    return corpus_wer(s, ["run_id"])


def raw_scores(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Scores where case and punctuation count."""
    return scores(pairs, raw_words(F.col(ref)), raw_words(F.col(hyp)))


def spelled(ws: Column) -> Column:
    return F.transform(ws, spell)


def spelling_split(ops: DataFrame) -> DataFrame:
    """(ref, hyp, n, spelling): substitutions with their count, marked where at most two letters differ."""
    return ops.where("op = 'sub'").groupBy("ref", "hyp").agg(F.count("*").alias("n")).withColumn("spelling", close_spelling(F.col("ref"), F.col("hyp")))


def spelling_errors(ops: Column) -> Column:
    """How many of an alignment's operations are substitutions of at most two letters."""
    return F.size(F.filter(ops, lambda o: (o["op"] == "sub") & close_spelling(o["ref"], o["hyp"]))).cast("long")


def spelling_forgiven(counted: DataFrame, by: list[str]) -> DataFrame:
    """(ref_words, errors, spelling, wer) per group: the rate without substitutions that are a matter of spelling."""
    e = F.sum(F.col("subs") + F.col("dels") + F.col("ins")).cast("long")
    s = F.sum(spelling_errors(F.col("ops")))
    n = F.sum("ref_words").cast("long")
    return counted.groupBy(*by).agg(n.alias("ref_words"), e.alias("errors"), s.alias("spelling"), F.try_divide((e - s).cast("double"), n).alias("wer"))


def source_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """(samples, wer, coverage, median) per group: ratios of sums and the middle rate of the samples."""
    n = F.sum("ref_words")
    rate = F.try_divide(F.col("errors").cast("double"), F.col("ref_words"))
    return scored.groupBy(*by).agg(F.count("*").alias("samples"), F.try_divide(F.sum("errors").cast("double"), n).alias("wer"), F.try_divide(F.sum("hyp_words").cast("double"), n).alias("coverage"), F.median(rate).alias("median"))


def match_counts(samples: DataFrame, hyps: DataFrame, key: str) -> DataFrame:
    """One row: calls with a hypothesis, calls without one and the samples of these."""
    per = samples.groupBy(key).agg(F.count("*").alias("_n")).join(hyps.select(key).distinct().withColumn("_h", F.lit(True)), key, "left")
    gone = F.col("_h").isNull()
    return per.agg(F.count_if(~gone).alias("calls"), F.count_if(gone).alias("unmatched_calls"), F.coalesce(F.sum(F.when(gone, F.col("_n"))), F.lit(0)).alias("unmatched_samples"))


def without_errors(results: DataFrame, error: str = "error") -> DataFrame:
    """Results of a run that didn't fail."""
    return results.where(F.col(error).isNull())


def ordered_text(df: DataFrame, key: str, order: Column, path: str, text: str) -> DataFrame:
    """Texts of each key joined in order, path breaking ties. A key's texts form one value: the key must be a call or document."""
    row = F.struct(order.alias("o"), F.col(path).alias("p"), F.col(text).alias("t"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), " ").alias("text"), F.count("*").alias("samples"))


def punctuation(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Per group: words, marks and marks per 100 words, sentences (stretches with more than blanks between . ! ?, within a row), their mean
    length in words and the share of words with a capital in percent."""
    t = F.col(text)
    parts = F.sum(F.size(F.filter(F.split(t, r"[.!?]+"), lambda x: F.trim(x) != ""))).cast("long")
    capitals = F.sum(F.size(F.filter(raw_words(t), lambda w: w.rlike(r"^\p{Lu}")))).cast("long")
    n = F.sum(F.size(raw_words(t))).cast("long")
    marks = {"dots": r"\.", "commas": ",", "questions": r"\?", "bangs": "!"}
    sums = {k: F.sum(F.regexp_count(t, F.lit(p))).cast("long") for k, p in marks.items()}
    return df.groupBy(*by).agg(n.alias("words"), *[v.alias(k) for k, v in sums.items()], *[F.try_divide(100.0 * v, n).alias(f"{k}_per_100") for k, v in sums.items()], parts.alias("sentences"), (n / F.greatest(parts, F.lit(1))).alias("sentence_words"), (100.0 * capitals / F.greatest(n, F.lit(1))).alias("capital_percent"))


def apostrophes(df: DataFrame, text: str) -> DataFrame:
    """(mark, n): how often each kind of apostrophe stands in the texts."""
    marks = F.regexp_extract_all(F.col(text), F.lit(f"([{APOSTROPHES}'])"), F.lit(1))
    return df.select(F.explode(marks).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))


