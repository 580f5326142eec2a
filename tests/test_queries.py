from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lexiframe.plans import catalogue

QUERIES = catalogue()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    f, sql = QUERIES[name]
    df = f(spark, sf)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if sql is None:
        return
    duck.execute(sql)
    names = [d[0] for d in duck.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(repr([plain(r[i]) for i in at]) for r in duck.fetchall()) == rows
