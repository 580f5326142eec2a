from __future__ import annotations

import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe import storage
from lexiframe.sinks import writers
from lexiframe.sources import audio, jobs as providers, tables
from lexiframe.streaming import jobs


def test_tables_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a.wav", 'says "x", twice'), ("b.wav", "two\nlines")], "path string, sentence string")
    writers.quoted_csv(d, str(tmp_path / "q"))
    assert sorted(map(tuple, tables.pairs_csv(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, d.collect()))
    writers.plain_csv(d, str(tmp_path / "p"))
    assert tables.pairs_csv(spark, str(tmp_path / "p")).count() == 2
    (tmp_path / "m.jsonl").write_text('{"path": "1_s1.wav", "duration": 2.5, "call_id": 1}\n\nnot json\n')
    m = tables.jsonl(spark, str(tmp_path / "m.jsonl")).cache()
    assert m.where("_corrupt_record is null").count() == 1 and m.where("_corrupt_record is not null").count() == 1
    writers.jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.partitioned(d.withColumn("split", F.lit("dev")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=dev").exists()


def test_json_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"csv": "x", "results": [{"path": "a", "reference": "r", "hypothesis": "h", "duration": 1.0, "proc": 0.1, "error": None}]}))
    assert tables.run_results(spark, str(tmp_path / "r.json"), "run").first()["hyp_text"] == "h"
    (tmp_path / "e.json").write_text(json.dumps({"target": 2, "locked_from_previous": [1], "calls": [{"call_id": 1}, {"call_id": 2}]}))
    assert {r["call_id"]: r["locked"] for r in tables.eval_spec(spark, str(tmp_path / "e.json")).collect()} == {1: True, 2: False}
    (tmp_path / "h.json").write_text(json.dumps({"a.wav": "x", "b.wav": "y"}))
    assert tables.text_map(spark, str(tmp_path / "h.json")).count() == 2
    d = spark.createDataFrame([(1, '[{"role": "r", "text": "a"}, {"text": "b"}]'), (2, None), (3, "[]"), (4, "broken")], "k int, segments_json string")
    assert [(r["k"], r["pos"], r["seg"]["text"]) for r in tables.segments(d).orderBy("k", "pos").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_listing_and_shards(spark, tmp_path):
    for n in ("1_p1.wav", "1_p2.wav", "x.wav"):
        (tmp_path / n).write_bytes(b"0")
    (tmp_path / "none").mkdir()
    d = spark.createDataFrame([("audio/1_p1.wav",), ("audio/9.wav",)], "path string")
    assert [r["path"] for r in tables.existing(d, spark, str(tmp_path), "*.wav").collect()] == ["audio/1_p1.wav"]
    assert [(r["call_id"], r["part"]) for r in tables.call_parts(spark, [str(tmp_path / "none"), str(tmp_path)], r"(\d+)_p(\d+)\.wav").collect()] == [("1", 1), ("1", 2)]
    spark.range(3).write.parquet(str(tmp_path / "d" / "train-0.parquet"))
    assert tables.shards(spark, [str(tmp_path / "d" / "train-0.parquet"), str(tmp_path / "d" / "test-0.parquet")], "train", 1).count() == 3
    assert tables.by_ids(d.withColumn("k", F.lit(1)), spark.createDataFrame([(1,), (1,)], "k int"), "k").count() == 2


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(16000) / 20).astype(np.float32)
    raw = audio.encode_wav(x)
    assert np.abs(audio.decode(raw) - x).max() < 1e-3
    assert len(audio.resample(x, 8000)) == 32000 and len(audio.resample(np.zeros(0), 8000)) == 0
    head = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + ((16000 << 44) | (1 << 41) | (15 << 36) | 48000).to_bytes(8, "big") + bytes(16)
    assert audio.flac_seconds(head) == 3.0 and audio.flac_seconds(b"no") is None
    (tmp_path / "a.wav").write_bytes(raw)
    (tmp_path / "b.wav").write_bytes(b"broken")
    f = audio.audio_files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["seconds"] for r in audio.durations(f).collect()} == {"a.wav": 1.0, "b.wav": None}
    got = {r["path"][-5:]: r["a"] for r in f.select("path", audio.analysed(F.col("content")).alias("a")).collect()}
    assert got["a.wav"]["seconds"] == 1.0 and got["b.wav"]["error"]
    rows = f.where(F.col("path").endswith("a.wav")).select(F.lit("s.wav").alias("name"), "content", F.lit(0.25).alias("start"), F.lit(0.75).alias("end"))
    assert writers.audio_slices(rows, "content", str(tmp_path / "out")).first()["bytes"] > 0
    assert len(audio.decode((tmp_path / "out" / "s.wav").read_bytes())) == 8000
    assert len(audio.decode(writers.joined_wav([raw, raw]))) == 32000
    rng = np.random.default_rng(0)
    for y in (audio.phone_augment(x, rng), audio.light_augment(x, rng)):
        assert np.isfinite(y).all() and np.abs(y).max() <= 1
    assert np.abs(audio.mu_law(x) - x).max() < 0.05


def test_reports_and_bundles(spark, tmp_path):
    d = spark.range(10)
    writers.report(d, {"n": F.count("*"), "top": F.max("id")}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"n": 10, "top": 9}
    m = spark.sql("select map('a_1', '1', 'b', '2', 'c', '3') as o, map('c', '4', 'd', '5') as n")
    assert m.select(writers.merged_report(F.col("o"), F.col("n"), "a_").alias("m")).first()["m"] == {"b": "2", "c": "4", "d": "5"}
    writers.bundle([("x.txt", b"1")], str(tmp_path / "t.tar"))
    assert writers.unbundle(str(tmp_path / "t.tar"), str(tmp_path / "u")) == ["x.txt"]
    assert writers.word_list(spark.createDataFrame([("b", 2), ("a", 1)], "w string, n int"), "w", [F.desc("n")], 2) == "b, a"


def test_remote_jobs(spark):
    d = spark.createDataFrame([("ok",), ("bad",)], "path string")

    def submit(p):
        if p == "bad":
            raise OSError
        return p

    got = {r["path"]: (r["text"], r["error"]) for r in providers.recognised(d, submit, lambda j: {"status": "COMPLETED", "text": "hi", "duration": 1.0, "proc": 0.5}).collect()}
    assert got == {"ok": ("hi", None), "bad": (None, "OSError")}


def _events(spark):
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(30):
        for k, s in enumerate(("IN_PROGRESS", "COMPLETED" if i % 5 else "FAILED", "COMPLETED" if i % 5 else "FAILED")):
            rows.append((f"j{i}", t + dt.timedelta(hours=i * 2, minutes=k), s, "success", float(i), 1.0, 500.0, 3 * i + k))
    return spark.createDataFrame(rows, "id string, at timestamp, status string, out_status string, duration_sec double, processing_time_sec double, delay_ms double, n int")


def test_stream_equals_batch(spark, tmp_path):
    e = _events(spark)
    batch = sorted(map(tuple, jobs.daily_stats(jobs.finished_once(e, "id", "at", "n"), "at").collect()))
    e.repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    far = e.limit(1).withColumn("at", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")).withColumn("id", F.lit("late")).withColumn("status", F.lit("COMPLETED"))
    far.write.parquet(str(tmp_path / "in" / "b"))
    s = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stream_daily(s, "id", "at").writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == batch


def test_stream_states_count_once(spark, tmp_path):
    e = _events(spark).where("id in ('j1', 'j2')")
    for n in range(3):
        e.where(F.col("n") % 3 == n).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        time.sleep(0.05)
    s = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_states(s, "id", "at").writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c"))
    q = out.trigger(availableNow=True).start()  # a query with timeouts never runs out of batches by itself
    assert q.awaitTermination(90)
    r = spark.table("states").groupBy("id").agg(F.count_if("counted").alias("n")).collect()
    assert {x["id"]: x["n"] for x in r} == {"j1": 1, "j2": 1}


def test_states_and_counters(spark):
    e = _events(spark)
    s = jobs.last_state(e, "id", "at", ["status", "duration_sec"], "n")
    assert s.count() == 30 and s.where("status = 'FAILED'").count() == 6
    c = spark.createDataFrame([("d", f"s{i:02d}", i, i) for i in range(15)], "day string, source string, at int, n int")
    got = {r["source"]: r["n"] for r in jobs.bounded_counter(c, "day", "source", "at", "n").collect()}
    assert len(got) == 13 and got["boshqa"] == 3
    assert jobs.feed(s, "at", "id", 5).count() == 5


def test_storage(spark):
    d = storage.durable(spark.range(5), "t")
    assert d.count() == 5
    storage.drop_durable(d)
    assert storage.small_enough(spark.range(5), 5) and not storage.small_enough(spark.range(6), 5)
    with pytest.raises(ValueError):
        storage.bounded_rows(spark.range(6), 5, "x")
    assert storage.bounded_broadcast(spark.range(6), 5) is not None
