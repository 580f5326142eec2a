"""Readers of manifests, CSV sets, run results, transcripts and shards. Schemas are fixed; nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "path string, sentence string, duration double, cps double, call_id long, part int, piece int, direction string, started_at string, date string, "
    "lead_id long, chunk string, was_long boolean, turns string, role_match double, split string, split_v1 string, claude_edited boolean"
)
RESULT = "csv string, model string, opts map<string,string>, wer double, sub long, del long, ins long, ref_words long, samples long, failed long, results array<struct<path: string, reference: string, hypothesis: string, duration: double, proc: double, error: string>>"
EVAL_SPEC = "target long, seed long, locked_from_previous array<long>, calls array<struct<call_id: long, batch: string, direction: string, duration: double, samples: int, words: int>>"
SEGMENTS = "array<struct<role: string, speaker: string, start: double, end: double, text: string>>"


def jsonl(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """JSON lines with the file they come from in src; blank lines are skipped, broken ones kept in _corrupt_record."""
    d = spark.read.schema(schema + ", _corrupt_record string").json(path)
    return d.withColumn("src", F.input_file_name())


def pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """path,sentence with a header, quotes doubled inside fields."""
    return spark.read.schema("path string, sentence string").csv(path, header=True, quote='"', escape='"', multiLine=True)


def run_results(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(run_id, path, ref_text, hyp_text, duration, proc, error): one row per result of a run."""
    d = spark.read.schema(RESULT).option("multiLine", True).json(path)
    r = d.select(F.explode("results").alias("r"))
    return r.select(F.lit(run_id).alias("run_id"), "r.path", F.col("r.reference").alias("ref_text"), F.col("r.hypothesis").alias("hyp_text"), "r.duration", "r.proc", "r.error")


def eval_spec(spark: SparkSession, path: str) -> DataFrame:
    """Calls of an evaluation spec, with locked."""
    d = spark.read.schema(EVAL_SPEC).option("multiLine", True).json(path)
    return d.select(F.explode("calls").alias("c"), "locked_from_previous").select("c.*", F.array_contains("locked_from_previous", F.col("c.call_id")).alias("locked"))


def text_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a JSON object {path: text}."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "text"))


def segments(df: DataFrame, column: str = "segments_json") -> DataFrame:
    """Rows of the JSON array in a text column, with pos; null, empty and broken ones give none."""
    return df.withColumn("_s", F.from_json(F.coalesce(F.col(column), F.lit("[]")), SEGMENTS)).select(*df.columns, F.posexplode("_s").alias("pos", "seg"))


def shards(spark: SparkSession, files: list[str], split: str, n: int) -> DataFrame:
    """The first n shards, by name, of a split."""
    chosen = sorted(f for f in files if f"/{split}-" in f)[:n]
    if not chosen:
        raise ValueError(f"no shard of {split}")
    return spark.read.parquet(*chosen)


def streamed(spark: SparkSession, path: str, n: int | None = None, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as it is scanned: the first n rows of the scan, which reads no more files than they need; without n a stream of
    `files_per_batch` files a batch."""
    if n is not None:
        return spark.read.parquet(path).limit(n)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def existing(df: DataFrame, spark: SparkSession, folder: str, pattern: str = "*", missing: str = "drop") -> DataFrame:
    """Rows whose file name exists below a folder; the listing is distributed and reads no content. missing: drop the others, or abort
    with an error that names some of them."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    names = there.select(F.element_at(F.split("path", "/"), -1).alias("_f")).distinct()
    d = df.withColumn("_f", F.element_at(F.split("path", "/"), -1))
    if missing == "abort":
        gone = [r["path"] for r in d.join(names, "_f", "left_anti").select("path").limit(5).collect()]
        if gone:
            raise FileNotFoundError(f"files are missing: {gone}")
    return d.join(names, "_f", "left_semi").drop("_f")


def audio_bytes(df: DataFrame, encoded: str = "audio_base64") -> DataFrame:
    """df with the bytes of a base64 column in content; null where it holds none or no base64."""
    return df.withColumn("content", F.try_to_binary(F.col(encoded), F.lit("base64")))


def call_parts(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """(path, call_id, part) of files whose whole name matches the pattern (groups: call, part), from the first folder that holds any."""
    for folder in folders:
        d = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
        d = d.where(F.col("name").rlike(f"^(?:{pattern})$"))
        if not d.isEmpty():
            return d.select("path", F.regexp_extract("name", pattern, 1).alias("call_id"), F.regexp_extract("name", pattern, 2).try_cast("int").alias("part")).orderBy("call_id", "part")
    return spark.createDataFrame([], "path string, call_id string, part int")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Lookup by a table of ids: a semi-join in place of batched IN lists."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def jdbc_by_key(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """Partitioned read by key ranges in place of OFFSET pages."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options).load()
