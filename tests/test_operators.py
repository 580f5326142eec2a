from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import chunking, compare, contracts, dedup, diarize, gates, mixing, scoring, splits, weighting
from lexiframe.plans import catalogue
from lexiframe.plans.common import known_manifest


@pytest.mark.parametrize("s,t,why", [(1.2, "abcdefgh", None), (30.0, "a" * 200, None), (1.0, "abcdefgh", "short"), (31.0, "a" * 300, "long"), (2.0, "abc", "text"), (2.0, "a" * 11, "cps"), (2.0, "a" * 53, "cps"), (2.0, "a" * 12, None), (2.0, "a" * 52, None), (None, "abcdefgh", "short"), (2.0, None, "text")])
def test_gate(spark, s, t, why):
    d = spark.createDataFrame([(s, t)], "s double, t string")
    assert d.select(gates.reason(gates.CALLS, F.col("s"), F.col("t")).alias("w")).first()["w"] == why


def test_gate_order_and_pieces(spark):
    d = spark.createDataFrame([(40.0, "ab")], "s double, t string")
    assert d.select(gates.reason(gates.CALLS, F.col("s"), F.col("t"), first=[(F.lit(True), "eval")]).alias("w")).first()["w"] == "eval"
    p = spark.createDataFrame([([(2.0, "a" * 20), (2.0, "ab")],), ([(2.0, "a" * 20)],)], "p array<struct<seconds: double, text: string>>")
    assert [r["k"] for r in p.select(gates.pieces_pass(F.col("p"), gates.CALLS).alias("k")).collect()] == [False, True]


def test_votes(spark):
    d = spark.createDataFrame([("a", 2, 0), ("b", 1, 1), ("c", 0, 0)], "k string, up_votes int, down_votes int")
    assert [r["k"] for r in gates.votes_v1(d).collect()] == ["a"]
    assert gates.votes_v1(d.drop("up_votes")).count() == 3
    t = spark.createDataFrame([("a", "2"), ("b", "many"), ("c", None)], "k string, up_vote string")
    assert sorted(r["k"] for r in gates.votes_v2(t, *mixing.vote_columns(t), 1).collect()) == ["a", "b"]


def test_contracts_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "call_id int, lead string")
    b = spark.createDataFrame([(2, "x"), (3, None)], "call_id int, lead string")
    for f in (lambda: contracts.disjoint(a, b, ["call_id"]), lambda: contracts.disjoint(a, b, ["lead"]), lambda: contracts.subset(a, b, ["call_id"]), lambda: contracts.unique(a.union(a), ["call_id"]), lambda: contracts.row_count(a, 3), lambda: contracts.scored_enough(10, 4), lambda: contracts.same_options({"beam": 1}, {"beam": 5})):
        with pytest.raises(contracts.ContractViolation):
            f()
    contracts.disjoint(a.where("call_id = 1").select("call_id"), b.select("call_id"), ["call_id"])
    contracts.row_count(a, 2)
    long = spark.createDataFrame([("a" * 61,)], "sentence string")
    with pytest.raises(contracts.ContractViolation):
        contracts.no_text_leak(long, long)


def test_weighting(spark):
    d = spark.createDataFrame([(i, i / 20) for i in range(20)], "k int, wer double")
    assert weighting.cutoff(d) == 0.95 and weighting.cutoff(d.where("k < 0")) is None
    x = spark.createDataFrame([(1, None), (2, 0.1), (3, 0.3), (4, 0.6)], "k int, wer double")
    got = weighting.replicate(x, weighting.repeat_factor(F.col("wer"))).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {1: 1, 2: 1, 3: 2, 4: 3}
    s = spark.createDataFrame([("p", 1), ("q", 2)], "path string, call_id int")
    r = weighting.with_scores(s, spark.createDataFrame([("p", 0.5)], "path string, wer double"), spark.createDataFrame([(2, 0.7)], "call_id int, wer double"))
    assert {x["path"]: x["wer"] for x in r.collect()} == {"p": 0.5, "q": 0.7}


def test_dedup(spark):
    d = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in dedup.first_rows(d, ["k"], ["o"]).collect()) == [("a", 1, "x"), ("b", 1, "z")]
    p = spark.createDataFrame([(1, None, "w"), (1, 1, "p"), (2, None, "w2")], "call_id int, part int, path string")
    assert sorted(r["path"] for r in dedup.prefer_parts(p).collect()) == ["p", "w2"]


def test_mixing(spark):
    d = spark.createDataFrame([(None, "b"), ("", None), (" a ", "c")], "sentence string, text string")
    assert sorted(r["sentence"] for r in mixing.resolved(d, "s").collect()) == ["a", "b"]
    assert mixing.oversample_ratio(100, 900, 0.5) == 9 and mixing.oversample_ratio(0, 9, 0.5) == 1
    assert mixing.text_column(d) == "sentence" and mixing.audio_column(d) is None
    a = spark.createDataFrame([((b"x", "p"),)], "wav struct<bytes: binary, path: string>")
    assert mixing.audio_column(a) == "wav"
    n = spark.range(100)
    assert mixing.capped(n, "id", 10, 1).collect() == mixing.capped(n.repartition(3), "id", 10, 1).collect()
    with pytest.raises(ValueError):
        mixing.resolved(n, "none")


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_group_split(spark, seed):
    d = spark.range(200).withColumn("g", F.col("id") % 40)
    s = splits.split_by_group(d, "g", 0.1, seed)
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    assert s.where("split = 'dev'").select("g").distinct().count() == 4
    assert splits.split_by_group(d.where("id < 0"), "g", 0.1, seed).count() == 0


def test_capped_fill(spark):
    d = spark.range(1000).select((F.col("id") % 100).alias("g"), F.lit(1.0).alias("s")).union(spark.range(300).select(F.lit(999).alias("g"), F.lit(1.0).alias("s")))
    s = splits.capped_fill(d, "g", F.col("s"), 0.1, 3)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert 120 <= n["dev"] <= 141 and s.where("g = 999 and split = 'dev'").isEmpty()


def test_quotas_and_picks(spark):
    d = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n int")
    assert {r["k"]: r["quota"] for r in splits.largest_remainder(d, "n", 7, ["k"]).collect()} == {"a": 4, "b": 2, "c": 1}
    assert sum(r["goal"] for r in splits.rounded_goals(d, "n", 7, ["k"]).collect()) == 7
    x = spark.range(10).withColumn("s", F.lit(1))
    assert [r["id"] for r in splits.systematic(x, ["s"], ["id"], F.lit(3)).orderBy("id").collect()] == [1, 5, 8]
    q = splits.quartile(x, ["s"], ["id"]).groupBy("quartile").count().collect()
    assert {r["quartile"]: r["count"] for r in q} == {0: 2, 1: 2, 2: 2, 3: 2, None: 2}
    f = spark.createDataFrame([(i, i % 2, "s") for i in range(6)], "call_id int, lead_id int, s string")
    first = splits.fresh_leads_first(f, ["s"], "lead_id", "call_id", 1).where("pick <= 2").select("lead_id").distinct().count()
    assert first == 2
    assert [tuple(r) for r in splits.round_robin(f, "lead_id", ["call_id"], 3).select("lead_id", "turn").collect()] == [(0, 1), (1, 1), (0, 2)]


def test_stratified_keeps_locked(spark):
    rows = [(i, "x" if i % 3 else "y", float(i), i % 7, i < 4) for i in range(60)]
    d = spark.createDataFrame(rows, "call_id int, batch string, duration double, lead_id int, locked boolean")
    s = splits.stratified_with_locked(d, ["batch"], 20, 5).collect()
    assert len(s) == 20 and {0, 1, 2, 3} <= {r["call_id"] for r in s} and sum(r["batch"] == "y" for r in s) == 7


def test_bootstrap(spark):
    u = spark.createDataFrame([(i, 10, 3, 3) for i in range(20)], "unit int, words int, a_errors int, b_errors int")
    r = compare.bootstrap_summary(compare.bootstrap_draws(u, 50, 0)).first()
    assert (r["lo"], r["hi"], r["p"], r["verdict"]) == (0.0, 0.0, 1.0, "not reliable")
    w = u.withColumn("b_errors", F.lit(6))
    assert compare.bootstrap_summary(compare.bootstrap_draws(w, 50, 0)).first()["verdict"] == "worse"


def test_scoring(spark):
    p = spark.createDataFrame([("a", ["x", "y"], ["x"]), ("a", [], ["z"]), ("b", [], ["z"])], "g string, r array<string>, h array<string>")
    s = scoring.scores(p, F.col("r"), F.col("h"))
    got = {r["g"]: (r["ref_words"], r["errors"], r["wer"]) for r in scoring.corpus_wer(s, ["g"]).collect()}
    assert got == {"a": (2, 2, 1.0), "b": (0, 1, None)}
    j = scoring.pair_up(spark.createDataFrame([("1", "Ha bor"), ("2", "..")], "path string, sentence string"), spark.createDataFrame([("1", ""), ("2", "x")], "path string, text string")).collect()
    assert [(r["path"], r["hyp_empty"]) for r in j] == [("1", True)]


def test_nearest_turn_and_segments(spark):
    w = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 5.0, 5.4, "b"), (1, 2, 2.9, 3.3, "c")], "k int, pos int, start double, end double, word string")
    t = spark.createDataFrame([(1, 0, 0.0, 1.5, "A"), (1, 1, 1.5, 3.0, "B")], "k int, turn_pos int, start double, end double, speaker string")
    got = {r["pos"]: r["speaker"] for r in diarize.nearest_turn(w, t, "k").collect()}
    assert got == {0: "A", 1: "B", 2: "B"}
    d = spark.createDataFrame([(1, i, float(i), i + 1.0, x, s) for i, (x, s) in enumerate([("a", "A"), ("b", "A"), ("c", "B"), ("d", "A")])], "k int, pos int, start double, end double, word string, speaker string")
    assert [(r["speaker"], r["text"]) for r in diarize.segments(d, "k").orderBy("island").collect()] == [("A", "a b"), ("B", "c"), ("A", "d")]
    assert diarize.first_speaker(d, "k").first()["speaker"] == "A"
    assert {(r["speaker"], r["label"]) for r in diarize.renamed(d, "k").collect()} == {("A", "Speaker 1"), ("B", "Speaker 2")}
    f = spark.createDataFrame([(1, 0, None), (1, 1, "s"), (1, 2, None)], "k int, pos int, role string")
    assert [r["r"] for r in f.select("pos", diarize.filled_roles(f, ["k"], ["pos"], "role").alias("r")).orderBy("pos").collect()] == ["s", "s", "s"]


def test_voice_profile(spark):
    rng = np.random.default_rng(0)
    base = {g: rng.normal(size=16) for g in ("a", "b")}
    rows = [(g, c, [float(x) for x in base[g] + rng.normal(scale=0.1, size=16)]) for g in base for c in range(5)]
    p = {r["g"]: np.array(r["profile"]) for r in diarize.voice_profiles(spark.createDataFrame(rows, "g string, c int, v array<double>"), "g", "c", "v").collect()}
    for g, x in p.items():
        u = base[g] / np.linalg.norm(base[g])
        assert float(x @ u) > 0.98
    s = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.1), (2, "x", 0.2)], "call int, speaker string, sim double")
    assert {r["call"]: r["role"] for r in diarize.decided_roles(s, "sim", "call").collect()} == {1: "sotuvchi", 2: "nomalum"}


def test_silences():
    mask = np.array([0, *[1] * 35, 0, *[1] * 10, 0], bool)
    assert [round(b - a, 2) for a, b in chunking.silence_runs(mask, 160)] == [0.35]
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.3, 16000), np.zeros(8000), np.random.default_rng(1).normal(0, 0.3, 16000)])
    m, step = chunking.silence_mask(x)
    runs = chunking.silence_runs(m, step)
    assert len(runs) == 1 and abs(runs[0][0] - 1) < 0.05 and abs(runs[0][1] - 1.5) < 0.05
    assert chunking.pick_silence([(1, 1.5), (3, 3.1), (4, 4.5)], 4, 3) == (4, 4.5)
    assert chunking.silence_mask(np.zeros(10))[0].size == 0


TEXT = "Bu birinchi gap bo'ladi shu yerda. " * 16


def _bounds(t):
    return [i + 2 for i, c in enumerate(t) if c == "." and i + 1 < len(t)]


@pytest.mark.parametrize("duration", [40.0, 55.0, 70.0])
def test_planners_conserve_text(duration):
    runs = [(i - 0.2, i + 0.2) for i in range(2, int(duration), 2)]
    text = TEXT[: int(duration * 12)]
    got, why = chunking.plan_search(runs, _bounds(text), text, duration)
    assert why is None and " ".join(p[2] for p in got).split() == text.split()
    assert all(e - s <= 30 for s, e, _ in got) and got[0][0] == 0 and got[-1][1] == duration
    assert chunking.plan_search([], _bounds(text), text, duration) == (None, "no_silence")
    assert chunking.plan_search(runs, [], text, duration) == (None, "no_sentence_boundary")
    v1 = chunking.plan_equal(runs, _bounds(text), text, duration)
    assert v1 is None or " ".join(p[2] for p in v1).split() == text.split()


def _exhaustive(runs, bounds, text, duration):
    reach = chunking.TEXT_TOLERANCE * len(text) / duration
    spots = [((a + b) / 2, min(b - a, 1.0), (a + b) / 2 / duration * len(text)) for a, b in runs]
    n0 = -int(-duration // 30)
    for n in (n0, n0 + 1):
        plans = []
        for some in combinations(spots, n - 1):
            cuts, cost = [0], 0.0
            for _, quiet, target in some:
                near = [b for b in bounds if b > cuts[-1] and abs(b - target) <= reach]
                if not near:
                    break
                cuts.append(min(near, key=lambda b: abs(b - target)))
                cost += abs(cuts[-1] - target) / len(text) - 0.01 * quiet
            if len(cuts) == n:
                pieces = chunking._assemble([x[0] for x in some], cuts[1:], text, duration)
                if chunking._fits([(b - a, x) for a, b, x in pieces], chunking.CALLS):
                    plans.append((cost, pieces))
        if plans:
            return min(plans, key=lambda x: x[0])
    return None


@pytest.mark.parametrize("seed", range(12))
def test_planner_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    duration = rng.uniform(31, 100)
    runs = [(t, t + rng.uniform(0.3, 1.5)) for t in sorted(rng.uniform(1, duration - 3) for _ in range(14))]
    text = " ".join("soz" * rng.randint(1, 3) + "." * (rng.random() < 0.3) for _ in range(int(duration * 2)))
    got, _ = chunking.plan_search(runs, _bounds(text), text, duration)
    want = _exhaustive(runs, _bounds(text), text, duration)
    assert got == (want and want[1])


def test_planner_of_long_samples():
    text = "Bu gap bor edi. " * 450
    runs = [(i - 0.2, i + 0.2) for i in range(2, 700, 2)]
    got, why = chunking.plan_search(runs, _bounds(text), text, 700.0)
    assert why is None and " ".join(p[2] for p in got).split() == text.split() and all(e - s <= 30 for s, e, _ in got)


def test_every_long_sample_is_planned(spark, sf):
    f, _ = catalogue()["long_sample_plans"]
    paths = known_manifest(spark, sf).where("duration > 30").select("path")
    got = f(spark, sf).select("path")
    assert paths.count() > 0 and sorted(r[0] for r in got.collect()) == sorted(r[0] for r in paths.collect())


def test_segment_planner_and_ranges():
    assert chunking.feasible_range(55, 1, 2) == (25.0, 30.0)
    ref = TEXT.split()[:90]
    segs = [(float(4 * (i + 1)), " ".join(ref[i * 8 : i * 8 + 8])) for i in range(11)] + [(46.0, " ".join(ref[88:]))]
    got = chunking.plan_segments(segs, [(i, i) for i in range(90)], ref, 46.0)
    assert got and " ".join(p[2] for p in got).split() == ref and all(e - s <= 30 for s, e, _ in got)


def _sentences(n, size=5):
    words = [f"soz{i}ning" for i in range(n * size)]
    s = [(i * size, i * size + size - 1, " ".join(words[i * size : (i + 1) * size])) for i in range(n)]
    return s, words, [(i * 0.7, i * 0.7 + 0.6) for i in range(len(words))]


def test_packing():
    s, w, t = _sentences(4)
    got, why = chunking.pack_sentences(s, w, w, t)
    assert len(got) == 1 and not why and got[0]["sentence"].split() == w
    s, w, t = _sentences(20)
    got, why = chunking.pack_sentences(s, w, w, t)
    assert len(got) >= 2 and all(c["end"] - c["start"] <= 30 for c in got) and sum((c["sentence"].split() for c in got), []) == w
    assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:], strict=False))
    assert chunking.pack_sentences(s, w, ["q"] * len(w), t)[0] == []
