"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop_at_exit, shared_dir
from . import sql
from .containers import capacity_of, fill_containers
from .encodings import garbled_documents, repaired_documents
from .forms import same_looking_pairs, same_looking_rows, with_form
from .groups import assign_splits, parted_calls
from .keys import known_call
from .leaks import leaked_passages
from .overlap import cross_split_pairs, cross_split_rows
from .pieces import files_below, manifest_pieces, split_files
from .quotas import draw_sample, stratum_report
from .sentences import sentence_units
from .turns import speaker_turns


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parted_calls(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "split_targets"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "split_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(_t(spark, sf_dir, "train"), "sentence", ["row_id"]).select("row_id", "start_pos", "end_pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(_t(spark, sf_dir, "train"), "row_id", "sentence")


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose sentence stands in several spellings, with the class of the spellings."""
    return same_looking_rows(_t(spark, sf_dir, "train"), "row_id", "sentence")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_form(_t(spark, sf_dir, "train").select("row_id", "sentence"), "sentence").select("row_id", "form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(_t(spark, sf_dir, "train"), _t(spark, sf_dir, "dev"), "row_id", "sentence").select("train_row_id", "dev_row_id")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row with a counterpart in the other split, with its class and its number of links."""
    return cross_split_rows(_t(spark, sf_dir, "train"), _t(spark, sf_dir, "dev"), ["row_id"], "sentence")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with a counterpart in the other split, and links, per split, src and call (null: from no call)."""
    rows = cross_split_rows(_t(spark, sf_dir, "train"), _t(spark, sf_dir, "dev"), ["row_id", "src", "path"], "sentence")
    m = _t(spark, sf_dir, "manifest")
    calls = m.select("path", known_call(F.col("call_id"), F.col("path")).alias("call_id")).where("path is not null").groupBy("path").agg(F.min("call_id").alias("call_id"))
    return rows.join(calls, "path", "left").groupBy("split", "src", "call_id").agg(F.count("*").alias("n_utterances"), F.sum("n_links").alias("n_links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a second piece, as it was cut."""
    second = manifest_pieces(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "size_limits")).where("piece_no = 2")
    # an aggregate: a filter would be pushed below the cuts and compute them again for each of its parts
    return second.groupBy("path").agg(F.max(F.coalesce(F.col("end_s") - F.col("start_s"), F.col("end_pos") - F.col("start_pos"))).alias("size")).where("size > 0").select("path")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_pieces(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "size_limits"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts as a few large files, cut by byte ranges: characters covered, the longest piece within its limit, and pieces
    that leave a gap behind the one before."""
    folder = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    _t(spark, sf_dir, "documents").where("text is not null").select("text").repartition(4).write.text(folder)
    pieces = split_files(spark, files_below(folder), 2000, 100, 1 << 20)
    before = F.lag("end_pos").over(Window.partitionBy("path").orderBy("piece_no"))
    d = pieces.select("path", "start_pos", "end_pos", F.length("piece").alias("n"), before.alias("before"))
    per = d.groupBy("path").agg(F.max("end_pos").alias("end"), F.max("n").alias("n"), F.count_if(F.col("start_pos") > F.coalesce("before", F.lit(0))).alias("gaps"))
    return per.agg(F.sum("end").alias("chars"), (F.max("n") <= 2000).alias("within"), F.sum("gaps").alias("gaps"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(_t(spark, sf_dir, "transcripts"), _t(spark, sf_dir, "speaker_labels")).select("call_key", "turn_no", "speaker", "n_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stratum_report(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "sample_targets"), _t(spark, sf_dir, "eval_calls_120"))
    return report.where("shortfall > 0").select("direction", "bucket")


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_sample(_t(spark, sf_dir, "manifest"), _t(spark, sf_dir, "sample_targets"), _t(spark, sf_dir, "eval_calls_120"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(_t(spark, sf_dir, "documents"), "doc_id", "text", capacity_of(_t(spark, sf_dir, "size_limits"), "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one place of the containers."""
    placed = p8_containers(spark, sf_dir).groupBy("doc_id").agg(F.min(F.struct("container", "start_byte")).alias("a"), F.max(F.struct("container", "start_byte")).alias("b"))
    return placed.where("a != b").select("doc_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_t(spark, sf_dir, "documents"), "doc_id", "text", _t(spark, sf_dir, "heldout_items"), "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("words >= 10").select("item_id", "doc_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(_t(spark, sf_dir, "documents"))


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_documents(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [p1_found, p1_splits, p2_found, p3_found, p3_rows, p3_forms, p4_found, p4_rows, p4_report, p5_found, p5_pieces, p5_files, p6_found, p7_found, p7_sample, p8_found, p8_containers, p9_found, p9_leaks, p10_found, p10_repaired]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
