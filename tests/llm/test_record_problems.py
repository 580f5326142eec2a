from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.llm import containers, groups, keys, pieces, queries, quotas

MANIFEST = "path string, call_id long, lead_id long, direction string, duration double, sentence string, split string"


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in groups.star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    assert groups.star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def manifest(spark):
    rng = random.Random(1)
    rows = []
    for c in range(400):
        lead = 77 if c % 10 == 0 else rng.choice([None, 0, 1000 + rng.randrange(150)])
        for s in range(rng.randint(1, 6)):
            other = 1000 + rng.randrange(150) if rng.random() < 0.02 else lead
            rows.append((f"audio/{c}_s{s}.flac", c if rng.random() < 0.9 else None, other, rng.choice(["out", " IN", None]), rng.choice([5.0, 12.5, 70.0, None, float("nan"), -1.0]), "gap", rng.choice(["train", " TRAIN", "dev", "removed", None])))
    return spark.createDataFrame(rows + rows[:30], MANIFEST).withColumn("component", F.lit(1)), rows


def test_splits_keep_groups_and_shares(spark):
    m, rows = manifest(spark)
    t = spark.createDataFrame([("train", 80), ("dev", 8), ("test", 12)], "split string, percent int")
    a = groups.assign_splits(m, t).toPandas()
    assert len(a) == len(rows) + 30 and a.groupby("component").split.nunique().max() == 1
    share = a.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.08) < 0.02
    call = {}
    for p, c, lead, *_ in rows:
        call.setdefault(int(p.split("/")[1].split("_")[0]), set()).add(lead)
    by_lead = defaultdict(set)
    for c, s in zip(a.call_id, a.split, strict=True):
        for lead in call[c]:
            if lead:
                by_lead[lead].add(s)
    assert max(map(len, by_lead.values())) == 1
    assert groups.assign_splits(m.where("1 = 0"), t).count() == 0


def test_parted_calls(spark):
    rows = [("a/1.f", 1, 9, None, None, None, "train"), ("a/2.f", None, 9, None, None, None, " DEV "), ("a/3.f", 3, 8, None, None, None, "train"), ("a/4.f", 4, 8, None, None, None, "removed"), ("a/5.f", 5, 0, None, None, None, "train"), ("a/6.f", 6, 0, None, None, None, "dev"), ("x", None, None, None, None, None, "dev"), (None, None, None, None, None, None, None)]
    t = spark.createDataFrame([("train", 80), ("dev", 20)], "split string, percent int")
    m = spark.createDataFrame(rows, MANIFEST)
    assert sorted(r[0] for r in groups.parted_calls(m, t).collect()) == [1, 2]
    assert groups.parted_calls(m.where("1 = 0"), t).count() == 0


def test_annealing_improves():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, (200, 3)).astype(float)
    target = np.outer([0.8, 0.1, 0.1], sizes.sum(0))
    start = rng.integers(0, 3, 200)
    w = np.ones(3)
    have = np.zeros_like(target)
    np.add.at(have, start, sizes)
    at, e = groups.anneal(sizes, start, target, w, 1)
    assert e < 0.1 * np.abs(have - target).sum()
    again = np.zeros_like(target)
    np.add.at(again, at, sizes)
    assert abs(np.abs(again - target).sum() - e) < 1e-6


def test_known_keys(spark):
    d = spark.createDataFrame([(None, "a/12_s1.f", 0, " Out ", float("nan")), (3, "x", None, "", 2.0)], "c long, p string, l long, d string, s double")
    r = d.select(keys.known_call(F.col("c"), F.col("p")), keys.known_lead(F.col("l")), keys.plain(F.col("d")), keys.known_seconds(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [(12, None, "out", None), (3, None, None, 2.0)]


def brute_cost(cells):
    short = {}
    for c in cells:
        short[c["direction"], c["bucket"]] = max(0, max(c["wanted"], c["floor"]) - c["available"])
    return short


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5), st.integers(0, 40)), min_size=6, max_size=6))
def test_flow_quotas(rows):
    cells = [{"direction": "ab"[i % 2], "bucket": "xyz"[i // 2], "wanted": w, "floor": f, "available": a, "locked": min(a, f)} for i, (w, f, a) in enumerate(rows)]
    plan = quotas.plan_quotas(cells)
    assert {(p["direction"], p["bucket"]): p["shortfall"] for p in plan} == brute_cost(cells)
    need = sum(max(c["wanted"], c["floor"], c["locked"]) for c in cells)
    assert sum(p["quota"] for p in plan) == min(need, sum(c["available"] for c in cells))
    assert all(c["locked"] <= p["quota"] <= c["available"] for c, p in zip(cells, plan, strict=True))


def test_sample(spark):
    m, _ = manifest(spark)
    t = spark.createDataFrame([(d, b, lo, hi, 150, 1) for d in ("out", "in", "?") for b, lo, hi in (("short", 0.0, 20.0), ("long", 20.0, None))] + [("none", "short", 0.0, 20.0, 100, 2)], "direction string, bucket string, min_seconds double, max_seconds double, per_mille int, min_calls int")
    e = spark.createDataFrame([(0, True), (1, True), (2, False), (99999, True)], "call_id long, locked boolean")
    s = quotas.draw_sample(m, t, e)
    got = s.toPandas()
    assert len(got) == 40 == got.call_id.nunique() and {0, 1} <= set(got.call_id)
    r = {(x["direction"], x["bucket"]): x for x in quotas.stratum_report(m, t, e).collect()}
    assert r["none", "short"]["shortfall"] == 4 and r["none", "short"]["quota"] == 0
    n = Counter(zip(got.direction, got.bucket, strict=True))
    assert all(n.get(k, 0) == x["quota"] for k, x in r.items())
    assert quotas.draw_sample(m.where("1 = 0"), t, e).count() == 0


@pytest.mark.parametrize("limits", [{"max_chars": 600, "overlap_chars": 40, "max_seconds": 30.0, "overlap_seconds": 1.5}, {"max_chars": 120, "overlap_chars": 10}, {"max_chars": 5, "overlap_chars": 2}])
def test_pieces(spark, limits):
    rng = random.Random(8)
    text = " ".join("Gap shu yerda tugaydi." if rng.random() < 0.3 else rng.choice(["uzun", "so'zlar", "bor,"]) for _ in range(400))
    rows = [(1, text, 45.0), (2, text, None), (3, "qisqa", 200.0), (4, None, 61.0), (5, "", None), (6, "x" * 1500, 20.0), (7, "qisqa gap", 10.0), (8, None, None), (9, text * 40, 3000.0)]
    d = spark.createDataFrame(rows, "k int, t string, s double").withColumn("piece_no", F.lit(0))
    p = pieces.split_oversized(d, ["k"], "t", F.col("s") if "max_seconds" in limits else None, limits).toPandas()
    texts, secs = {k: t or "" for k, t, _ in rows}, {k: s for k, _, s in rows}
    over = {k for k in texts if len(texts[k]) > limits["max_chars"] or ("max_seconds" in limits and (secs[k] or 0) > 30)}
    assert set(p.k) == over
    for k, g in p.sort_values("piece_no").groupby("k"):
        t = texts[k]
        assert all(t[a:b] == x for a, b, x in zip(g.start_pos, g.end_pos, g.piece, strict=True))
        assert g.start_pos.iloc[0] == 0 and g.end_pos.iloc[-1] == len(t) and len(g) >= 2
        assert (g.start_pos.to_numpy()[1:] <= g.end_pos.to_numpy()[:-1]).all() and (g.piece.str.len() <= limits["max_chars"]).all()
        if "max_seconds" in limits and (secs[k] or 0) > 30:
            assert ((g.end_s - g.start_s) <= 30 + 1e-6).all()
        # the limit that asks for the shorter pieces rules the overlap
        if "max_seconds" in limits and (secs[k] or 0) > 30 and 30 * len(t) < limits["max_chars"] * secs[k]:
            assert ((g.end_s.to_numpy()[:-1] - g.start_s.to_numpy()[1:]) >= 1.5 - 1e-6).all()
        elif len(t) > limits["max_chars"] and limits["max_chars"] > 100:
            assert ((g.end_pos.to_numpy()[:-1] - g.start_pos.to_numpy()[1:]) >= limits["overlap_chars"]).all()


@pytest.mark.parametrize("size", [777, 5000, 1 << 20])
def test_file_pieces_do_not_depend_on_ranges(spark, tmp_path, size):
    rng = random.Random(3)
    text = " ".join(rng.choice(["Гап шу ерда тугади.", "uzun", "söz,", "日本", "\n"]) for _ in range(3000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "e.txt").write_text("")
    p = pieces.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "e.txt")], 300, 20, size).toPandas().sort_values("piece_no")
    assert all(text[a:b] == x for a, b, x in zip(p.start_pos, p.end_pos, p.piece, strict=True)) and (p.piece.str.len() <= 300).all()
    assert p.start_pos.iloc[0] == 0 and p.end_pos.iloc[-1] == len(text)
    want = pieces.split_oversized(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t", None, {"max_chars": 300, "overlap_chars": 20}).toPandas().sort_values("piece_no")
    assert list(p.start_pos) == list(want.start_pos) and list(p.end_pos) == list(want.end_pos)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 4))
def test_buckets_are_optimal(sizes, k):
    s = np.unique(sizes)
    counts = np.array([sizes.count(x) for x in s])

    def pad(bounds):
        return sum(next(b for b in sorted(bounds) if b >= x) * c - x * c for x, c in zip(s, counts, strict=True))

    from itertools import combinations

    best = min(pad([*c, s[-1]]) for r in range(min(k, len(s))) for c in combinations(s[:-1], r))
    got = containers.optimal_buckets(s, counts, k)
    assert len(got) <= k and got[-1] == s[-1] and pad(got) == best


def test_cut_points():
    data = "aжц日🙂".encode() * 50
    spans = containers.cut_points(data, 7)
    assert b"".join(data[a:b] for a, b in spans) == data and all(b - a <= 7 for a, b in spans)
    assert all(data[a:b].decode() for a, b in spans)


def test_containers(spark):
    rng = random.Random(6)
    rows = [(i, "ж" * rng.randint(0, 60) + "a" * rng.randint(0, 90)) for i in range(2000)] + [(5000, "a" * 1000), (5001, None), (5002, "")]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("container", F.lit(0)).withColumn("bucket", F.lit(0))
    c = containers.fill_containers(d, "doc_id", "text", 256, 16).toPandas()
    size = {k: len((t or "").encode()) + 1 for k, t in rows}
    assert set(c.doc_id) == set(size) and c.groupby("container").tokens.sum().max() <= 256
    n = c.groupby("doc_id").size()
    assert all(n[k] == 1 for k, s in size.items() if s <= 256) and n[5000] == 4
    whole = c[c.doc_id != 5000]
    assert all(size[k] == t for k, t in zip(whole.doc_id, whole.tokens, strict=True))
    assert c.container.nunique() <= 1.1 * c.tokens.sum() / 256
    assert containers.fill_containers(d.where("1 = 0"), "doc_id", "text", 256).count() == 0
    with pytest.raises(ValueError):
        containers.fill_containers(d, "doc_id", "text", 4)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_match_sql(spark, sf, name):
    import duckdb

    df = queries.queries()[name](spark, sf)
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in ("manifest", "split_targets", "size_limits", "sample_targets", "eval_calls_120", "documents", "heldout_items"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        c.execute(sql)
        names = [x[0] for x in c.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[names.index(k)] for k in df.columns) for r in c.fetchall())


def test_floors_are_balanced_against_the_size():
    """Wanted 50, 45, 3 and 2 of 100 with floors of 20: the floors stand, the others give up their share in proportion."""
    cells = [{"direction": "x", "bucket": str(k), "wanted": w, "floor": 20, "available": 500, "locked": 0} for k, w in enumerate((50, 45, 3, 2))]
    plan = quotas.fitted(quotas.plan_quotas(cells), 100)
    assert [p["quota"] for p in plan][2:] == [20, 20] and sum(p["quota"] for p in plan) == 100
    assert abs(plan[0]["given_up"] / 30 - plan[1]["given_up"] / 25) < 0.1 and not any(p["shortfall"] for p in plan)
    assert [p["quota"] for p in quotas.fitted(plan, 1000)] == [p["quota"] for p in plan]
    locked = [c | {"locked": 60} for c in cells]
    assert sum(p["quota"] for p in quotas.fitted(quotas.plan_quotas(locked), 100)) == 240  # locked calls stand


def test_many_labels_count_together(spark):
    rows = [(f"c{k}", 1 + k % 3, {f"label{k % 90}": 1 + k % 3}, "train", "train") for k in range(600)]
    comps = spark.createDataFrame(rows, "component string, n long, labels map<string,long>, first_split string, last_split string")
    got = groups.component_splits(comps, [("dev", 0.2), ("train", 0.8)], max_labels=10)
    assert got.count() == 600
    share = got.groupBy("split").agg(F.sum("n").alias("n")).collect()
    assert abs(next(r["n"] for r in share if r["split"] == "dev") / sum(r["n"] for r in share) - 0.2) < 0.02
