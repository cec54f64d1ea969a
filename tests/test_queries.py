"""Every raster query with SQL gives the rows of its SQL on the smallest tables."""

import math

import pytest

from pixelweave.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL walks objects pixel by pixel, which takes it long.
SLOW = {"g7_tissue_objects", "g8_fill_objects"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, D)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[i]) for i in order]) for r in rows) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_no_python_in_mask_algebra(spark):
    plan = registry.queries()["k4_slide_scores"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
