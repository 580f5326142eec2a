from __future__ import annotations

import math
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.functions import align, stats
from lexiframe.functions.text import clean_repeats
from lexiframe.operators import chunking, compare, mixing, scoring, splits, weighting
from lexiframe.sinks import writers
from lexiframe.sources import audio, tables
from lexiframe.streaming import jobs


def test_python_round(spark):
    rng = random.Random(3)
    xs = [2.675, 0.125, 0.375, 1.005, 2.5, 0.285, 1e-9, 0.0, 123456.785] + [round(rng.uniform(0, 1000), rng.randint(1, 5)) for _ in range(3000)] + [k / 8 + 0.005 for k in range(500)]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2, 3, 4):
        for r in d.select("x", stats.python_round(F.col("x"), digits).alias("y")).collect():
            assert r["y"] == round(r["x"], digits), (r, digits)


def test_ranks_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(g, x) for g in "abc" for x in [round(rng.uniform(-5, 40), 1) for _ in range({"a": 1, "b": 2, "c": 301}[g])]]
    d = spark.createDataFrame([*rows, ("a", None), ("c", float("nan"))], "g string, x double")
    n = F.col("n")
    got = {r["g"]: r for r in stats.at_ranks(d, ["g"], "x", {"lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2), "last": n - 1}).collect()}
    for g in "abc":
        xs = sorted(x for k, x in rows if k == g)
        assert (got[g]["lo"], got[g]["hi"], got[g]["last"], got[g]["n"]) == (xs[(len(xs) - 1) // 2], xs[len(xs) // 2], xs[-1], len(xs))
    assert stats.at_ranks(d.where("false"), ["g"], "x", {"lo": F.lit(0)}).count() == 0
    assert weighting.cutoff(d.withColumnRenamed("x", "wer").where("g = 'c'"), "wer") == sorted(x for k, x in rows if k == "c")[int(0.95 * 301)]


@pytest.mark.parametrize("seed", range(4))
def test_capped_fill_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    groups = {f"g{k}": round(rng.expovariate(1 / (5 if k % 9 else 60)), 3) for k in range(400)}
    d = spark.createDataFrame(list(groups.items()), "grp string, s double")
    got = {r["grp"] for r in splits.capped_fill(d, "grp", F.col("s"), 0.1, seed).where("split = 'dev'").collect()}
    rank = {r["grp"]: r["h"] for r in d.select("grp", splits.hashed_rank(F.col("grp"), seed).alias("h")).collect()}
    total, have, want = sum(groups.values()), 0.0, set()
    for g in sorted(groups, key=lambda g: (rank[g], g)):
        if groups[g] > 0.03 * total:
            continue
        if have >= 0.1 * total:
            break
        if have + groups[g] <= 0.108 * total:
            want.add(g)
            have += groups[g]
    assert got == want


def test_numbered(spark):
    d = spark.range(500).select(F.concat(F.lit("u"), "id").alias("unit"))
    assert sorted(r["i"] for r in compare.numbered(d, "unit", 16).collect()) == list(range(500))


def test_roles_projected():
    whole = "salom men sotuvchiman ha eshitaman buyurtma kerak".split()
    roles = ["sotuvchi"] * 3 + ["mijoz"] * 4
    got, share = align.project_roles("Salom, men sotuvchiman! Ha eshitaman.", whole, roles)
    assert got == "[SOTUVCHI] Salom, men sotuvchiman! [MIJOZ] Ha eshitaman." and share == 1.0
    assert align.project_roles("butunlay boshqa gap", whole, roles) == (None, 0.0)
    assert align.project_roles(" , ", whole, roles) == (None, 0.0)
    # one unknown word of eleven takes the role before it
    piece = " ".join(["salom", "men", "X", "sotuvchiman", "ha", "eshitaman", "buyurtma", "kerak"] + whole[:0])
    assert align.project_roles(piece, whole, roles)[0] is None or align.project_roles(piece, whole, roles)[1] < 0.9


def test_segment_windows(spark):
    hyp = "bir ikki uch tort besh olti yetti sakkiz".split()
    segs = [["bir", "ikki", "uch"], ["a", "b"], ["x", "y", "z"], ["olti", "yetti", "sakkiz"]]
    d = spark.createDataFrame([(segs, hyp)], "s array<array<string>>, h array<string>")
    got = d.select(F.explode(align.segment_windows(F.col("s"), F.col("h"))).alias("x")).select("x.*").collect()
    assert [r["note"] for r in got] == [None, "short", "unreliable", None]
    assert got[0]["errors"] is not None and got[3]["errors"] <= 2


def test_planners_as_columns(spark):
    text = " ".join(f"Bu {k} chi gap bo'lib turadi." for k in range(30))
    runs = [(k * 2.0 - 0.2, k * 2.0 + 0.2) for k in range(1, 27)]
    bounds = [i + 1 for i, c in enumerate(text) if c == "."]
    d = spark.createDataFrame([(runs, bounds, text, 55.0), (None, None, None, None)], "r array<struct<start: double, end: double>>, b array<int>, t string, d double").repartition(1)
    out = d.select(chunking.planned(F.col("r"), F.col("b"), F.col("t"), F.col("d"), voiced=True).alias("p"), chunking.planned_equal(F.col("r"), F.col("b"), F.col("t"), F.col("d")).alias("e")).collect()
    assert "".join(x["text"] for x in out[0]["p"]["pieces"]).replace(" ", "") == text.replace(" ", "")
    assert out[1]["p"]["pieces"] is None and out[1]["e"] is None
    words = [f"soz{k}" for k in range(120)]
    segs = [((k + 1) * 4.5, " ".join(words[k * 10 : k * 10 + 10])) for k in range(12)]
    s = spark.createDataFrame([(segs, " ".join(words), 54.0)], "s array<struct<end: double, text: string>>, r string, d double")
    got = s.select(chunking.planned_segments(F.col("s"), F.col("r"), F.col("d")).alias("p")).first()["p"]
    assert " ".join(x["text"] for x in got) == " ".join(words) and all(x["end"] - x["start"] <= 30 for x in got)
    assert chunking.plan_segments(segs[:1], [(0, 0)] * 9, words, 54.0) is None  # too few words


def test_packed_column(spark):
    ref = [f"w{k}" for k in range(40)]
    times = [(k * 0.5, k * 0.5 + 0.4) for k in range(40)]
    sents = [(f"{' '.join(ref[a:a + 5])}.", a, a + 4) for a in range(0, 40, 5)]
    d = spark.createDataFrame([(sents, ref, ref, times)], "s array<struct<sentence: string, first_word: int, last_word: int>>, r array<string>, h array<string>, t array<struct<start: double, end: double>>")
    got = d.select(chunking.packed(F.col("s"), F.col("r"), F.col("h"), F.col("t")).alias("p")).first()["p"]
    assert len(got["chunks"]) == 1 and got["why"] == [] and got["chunks"][0]["end"] == pytest.approx(19.9)


def test_audio_columns(spark, tmp_path):
    x = np.sin(np.arange(1600) / 9).astype(np.float32)
    assert audio.mu_law(np.zeros(8, np.float32)).tolist() == [0.0] * 8  # silence stays silence
    assert np.abs(audio.mu_law(x) - x).max() < 0.03
    kept = sum(np.allclose(y / np.abs(y).max(), x / np.abs(x).max(), atol=1e-4) for y in (audio.light_augment(x, np.random.default_rng(k)) for k in range(80)) if len(y) == len(x))
    assert 8 <= kept <= 34  # a quarter has neither another speed nor noise
    d = spark.createDataFrame([(x.tolist(), 5), (None, 6)], "x array<float>, k int")
    for f in (audio.phone_augmented, audio.light_augmented):
        a, b = (d.select(f(F.col("x"), F.col("k")).alias("y")).collect() for _ in range(2))
        assert a == b and a[1]["y"] is None
    y = d.select(audio.resampled(F.col("x"), F.lit(8000)).alias("y"), audio.companded(F.col("x")).alias("c")).first()
    assert len(y["y"]) == 3200 and len(y["c"]) == 1600
    parts = spark.createDataFrame([(1, 2, audio.encode_wav(x)), (1, 1, audio.encode_wav(x[:100]))], "c long, p int, b binary")
    got = writers.joined_calls(parts, "c", "p", "b").first()
    assert got["parts"] == 2 and len(audio.decode(bytes(got["content"]))) == 1700
    with pytest.raises(ValueError):
        writers.joined_wav([audio.encode_wav(x, 8000)])


def test_sources_and_order(spark, tmp_path):
    d = spark.createDataFrame([(k, "matn" * (k % 4), ) for k in range(20)], "id int, text string")
    u, failed = mixing.union_of({"a": lambda: d, "b": lambda: spark.read.parquet(str(tmp_path / "no"))})
    assert u.count() == 15 and failed == {"b": "AnalysisException"}
    assert mixing.union_of({})[0] is None
    assert [r["id"] for r in mixing.until_kept(d, ["id"], F.length("text") > 4, 3, 12).collect()] == [2, 3, 6]
    assert mixing.published(d.withColumn("_lead", F.lit(1))).columns == ["id", "text"]
    a = spark.createDataFrame([((b"x", "p"),)], "sound struct<bytes: binary, path: string>")
    assert mixing.with_audio(a).columns == ["audio"]
    with pytest.raises(ValueError):
        mixing.with_audio(d)
    (tmp_path / "x.wav").write_bytes(b"1")
    p = spark.createDataFrame([("a/x.wav",), ("a/y.wav",)], "path string")
    assert tables.existing(p, spark, str(tmp_path), "*.wav").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.existing(p, spark, str(tmp_path), "*.wav", missing="abort")
    assert tables.audio_bytes(spark.createDataFrame([("QUI=",), ("%%",), (None,)], "audio_base64 string")).select("content").collect() == [(bytearray(b"AB"),), (None,), (None,)]


def test_runs_compared(spark):
    runs = spark.createDataFrame([("b", 0.2), ("a", 0.3)], "run_id string, wer double")
    r = compare.run_difference(runs).first()
    assert (r["run_a"], r["run_b"], r["verdict"]) == ("a", "b", "better") and math.isclose(r["difference"], -10)
    assert compare.run_difference(runs.where("run_id = 'a'")).count() == 0
    s = spark.createDataFrame([("x", 1, 4), ("x", 3, 4), ("y", 0, 0)], "call_id string, errors long, ref_words long")
    o = compare.old_and_new(s, spark.createDataFrame([("x", 0.7), ("z", 0.1)], "call_id string, wer double")).first()
    assert (o["calls"], o["new_wer"], o["old_wer"]) == (1, 0.5, 0.7)
    assert scoring.match_counts(s, s.where("call_id = 'x'"), "call_id").first().asDict() == {"calls": 1, "unmatched_calls": 1, "unmatched_samples": 1}


def test_repeats_keep_numbers(spark):
    """A part behind the first one keeps digits at its edges."""
    d = spark.createDataFrame([("Bir. 1 ikki 1. 2 uch 2",)], "t string")
    assert d.select(clean_repeats(F.col("t")).alias("c")).first()["c"] == "Bir. 1 ikki 1. 2 uch 2"


def test_stream_forms(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(k, f"2024-01-0{1 + k % 2}", f"s{k % 15}") for k in range(60)]
    d = spark.createDataFrame(rows, "id int, day string, source string")
    for k in range(3):
        d.where(F.pmod("id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(src)
    s = tables.streamed(spark, src)
    jobs.stream_counters(s, str(tmp_path / "c"), "day", "source", "id", "id", str(tmp_path / "k1")).trigger(availableNow=True).start().awaitTermination()
    last = max(os.listdir(tmp_path / "c"), key=lambda v: int(v[1:]))
    got = sorted(jobs.counters_of(spark.read.parquet(str(tmp_path / "c" / last)), "day", "source").collect())
    assert got == sorted(jobs.bounded_counter(d, "day", "source", "id", "id").collect())
    n = jobs.pull_until(tables.streamed(spark, src), F.col("id") % 2 == 0, 12, str(tmp_path / "out"), str(tmp_path / "k2"), ["id"])
    assert n == 12 == spark.read.parquet(str(tmp_path / "out")).count()
    loss = spark.createDataFrame([("r", k, x) for k, x in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 1.0])], "run string, step int, loss double")
    loss.coalesce(1).write.parquet(str(tmp_path / "loss"))
    q = jobs.stream_early_stop(tables.streamed(spark, str(tmp_path / "loss")), "run", "step", "loss", 3).writeStream.format("memory").queryName("stops").option("checkpointLocation", str(tmp_path / "k3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("stops").collect()] == [("r", 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 30))
def test_anchor_map(pairs, i):
    got = align.map_index(pairs, i)
    near = [p for p in pairs if abs(p[0] - i) <= 3]
    assert (got is None) == (not near)


def test_durable_tables_go_with_the_application(tmp_path):
    """In a session of its own: the shared folder is empty again when the program has ended."""
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from lexiframe.session import local_session
from lexiframe import storage
s = local_session(2, 2, "ends", **{{"spark.checkpoint.dir": "file://{tmp_path}/shared"}})
d = storage.durable(s.range(10), "t")
assert d.count() == 10 and "shared" in d.inputFiles()[0]
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    for _ in range(60):  # the JVM ends after the program
        if not [f for f in os.listdir(tmp_path / "shared") if f.startswith("t-")]:
            break
        time.sleep(0.5)
    assert [f for f in os.listdir(tmp_path / "shared") if f.startswith("t-")] == []
