from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.operators import progress


def test_early_stop(spark):
    rows = [("a", i, x) for i, x in enumerate([3.0, 2.0, 2.5, None, 2.0, 1.0])] + [("b", i, x) for i, x in enumerate([3.0, 2.0, 1.0])]
    d = spark.createDataFrame(rows, "run string, step int, loss double")
    assert {r["run"]: r["stop_step"] for r in progress.early_stop(d, "run", "step", "loss", 2).collect()} == {"a": 4, "b": None}


def test_best_checkpoint_and_projection(spark):
    d = spark.createDataFrame([("a", "x/checkpoint-900/s.json", "x/checkpoint-800"), ("a", "x/checkpoint-1000/s.json", "x/checkpoint-850"), ("b", "y/s.json", None)], "run string, path string, best string")
    assert {r["run"]: r["checkpoint"] for r in progress.best_checkpoint(d, "run", "path", "best").collect()} == {"a": "x/checkpoint-850", "b": "y/s.json"}
    r = spark.range(1).select(progress.projected_seconds(F.lit(10), F.lit(20.0), F.lit(100)).alias("a"), progress.projected_seconds(F.lit(0), F.lit(0.0), F.lit(100)).alias("b")).first()
    assert (r["a"], r["b"]) == (200.0, None)
    t = spark.createDataFrame([(1, 448), (2, 449), (3, None)], "k int, n int")
    assert [x["k"] for x in progress.within_labels(t, F.col("n")).collect()] == [1]
