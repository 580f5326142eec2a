"""Round trips: tables written in each of the library's formats to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sinks import writers
from ..sources import tables
from ..storage import drop_at_exit, shared_dir
from .common import table
from .queries import query


def _folder(spark, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


@query("select path, sentence, call_id, part, duration from (select distinct path, sentence, call_id, part, duration from manifest where path is not null and not coalesce(isnan(duration), false))")
def manifest_as_json_lines(spark, sf_dir):
    path = _folder(spark, "jsonl")
    cols = ["path", "sentence", "call_id", "part", "duration"]
    writers.jsonl(table(spark, sf_dir, "manifest").where("path is not null and not isnan(duration)").select(*cols).distinct(), path)
    return tables.jsonl(spark, path).where("_corrupt_record is null").select(*cols)


@query("select path, sentence from train where path is not null and sentence <> ''")
def pairs_as_quoted_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    writers.quoted_csv(table(spark, sf_dir, "train").where("path is not null and sentence != ''").select("path", "sentence"), path)
    return tables.pairs_csv(spark, path)


@query("select path, sentence from dev where path is not null and sentence <> ''")
def pairs_as_plain_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    writers.plain_csv(table(spark, sf_dir, "dev").where("path is not null and sentence != ''").select("path", "sentence"), path)
    return tables.pairs_csv(spark, path)


@query("select path, sentence from dev where path is not null and sentence <> ''")
def pairs_with_bare_header(spark, sf_dir):
    path = _folder(spark, "csv")
    writers.bare_header_csv(table(spark, sf_dir, "dev").where("path is not null and sentence != ''").select("path", "sentence"), path)
    return tables.pairs_csv(spark, path)


@query("select split, count(*) as n from (select coalesce(nullif(lower(trim(split)), ''), 'unset') as split from manifest) group by 1")
def manifest_by_split(spark, sf_dir):
    """Written in partitions by split; the count reads directory names alone."""
    path = _folder(spark, "parts")
    s = F.coalesce(F.nullif(F.lower(F.trim("split")), F.lit("")), F.lit("unset"))
    writers.partitioned(table(spark, sf_dir, "manifest").select("path", s.alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("select count(*) as rows, count(distinct call_id) as calls, max(duration) as longest from manifest where not coalesce(isnan(duration), false)")
def manifest_report(spark, sf_dir):
    path = _folder(spark, "report")
    writers.report(table(spark, sf_dir, "manifest").where("not isnan(duration)"), {"rows": F.count("*"), "calls": F.count_distinct("call_id"), "longest": F.max("duration")}, path)
    return spark.read.schema("rows long, calls long, longest double").json(path)


@query("select 'a' as run_id, path, sentence as ref_text, lower(sentence) as hyp_text, length(sentence)::double as duration from dev where path is not null and sentence is not null")
def run_as_json(spark, sf_dir):
    """Results of a run as one JSON document, read row by row."""
    path = _folder(spark, "run")
    r = F.struct("path", F.col("sentence").alias("reference"), F.lower("sentence").alias("hypothesis"), F.char_length("sentence").cast("double").alias("duration"))
    d = table(spark, sf_dir, "dev").where("path is not null and sentence is not null").groupBy(F.lit("dev").alias("csv")).agg(F.collect_list(r).alias("results"))
    writers.jsonl(d, path)
    return tables.run_results(spark, path, "a").select("run_id", "path", "ref_text", "hyp_text", "duration")


@query("select call_id, locked from eval_calls_120")
def eval_spec_as_json(spark, sf_dir):
    path = _folder(spark, "spec")
    e = table(spark, sf_dir, "eval_calls_120")
    c = F.struct("call_id", "batch", "direction", "duration", "samples", "words")
    writers.jsonl(e.agg(F.lit(120).cast("long").alias("target"), F.collect_list(F.when(F.col("locked"), F.col("call_id"))).alias("locked_from_previous"), F.collect_list(c).alias("calls")), path)
    return tables.eval_spec(spark, path).select("call_id", "locked")


@query("select path, min(sentence) as text from dev where path is not null and sentence is not null group by 1")
def texts_as_json_map(spark, sf_dir):
    path = _folder(spark, "map")
    d = table(spark, sf_dir, "dev").where("path is not null and sentence is not null").groupBy("path").agg(F.min("sentence").alias("text"))
    d.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "text")))).alias("value")).coalesce(1).write.text(path)
    return tables.text_map(spark, path)


@query("select doc_id from documents where lang = 'en'")
def shards_by_name(spark, sf_dir):
    """Documents as shards of two splits; the first two shards of one are read."""
    folder = _folder(spark, "shards")
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    files = []
    for k in range(2):
        files.append(f"{folder}/train-{k:05d}")
        d.where(F.pmod("doc_id", F.lit(2)) == k).write.parquet(files[-1])
    d.write.parquet(f"{folder}/test-00000")
    return tables.shards(spark, [*files, f"{folder}/test-00000"], "train", 2)


@query("select db_call_id, duration from calls where db_call_id in (select call_id from eval_calls_120)")
def calls_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "eval_calls_120").select(F.col("call_id").alias("db_call_id"))
    return tables.by_ids(table(spark, sf_dir, "calls").select("db_call_id", "duration"), ids, "db_call_id")


@query("select 'call_' || call_id || '_p' || samples || '.wav' as name, call_id::varchar as call_id, samples as part from eval_calls_120")
def parts_of_calls(spark, sf_dir):
    """Audio files of calls: headers of silence are written, listed by name, and those that a table names are kept."""
    folder = _folder(spark, "audio")
    e = table(spark, sf_dir, "eval_calls_120").select(F.format_string("call_%d_p%d.wav", "call_id", "samples").alias("name"), F.unhex(F.lit("52494646")).alias("content"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    writers.files(e, "name", "content", folder)
    parts = tables.call_parts(spark, [folder], r"call_(\d+)_p(\d+)\.wav")
    return tables.existing(parts, spark, folder, missing="abort").select(F.element_at(F.split("path", "/"), -1).alias("name"), "call_id", "part")


@query("select count(*) as rows, sum(strlen(text))::bigint as bytes from documents where text is not null")
def base64_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.base64(F.encode("text", "UTF-8")).alias("audio_base64"))
    return tables.audio_bytes(d).agg(F.count("content").alias("rows"), F.sum(F.octet_length("content")).alias("bytes"))


@query("select count(*) as n from events")
def streamed_events(spark, sf_dir):
    """The events as a stream of files, taken until all are there."""
    from ..streaming.jobs import pull_until

    path, out = _folder(spark, "stream"), _folder(spark, "pulled")
    table(spark, sf_dir, "events").select("event_id", "value").repartition(4).write.parquet(path)
    n = pull_until(tables.streamed(spark, path), F.col("value").isNotNull(), (1 << 31) - 1, out, _folder(spark, "checkpoint"), ["event_id"])
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))
