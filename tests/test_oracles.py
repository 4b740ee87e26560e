"""Every registered query against its SQL on the smallest tables, in one session."""

import glob
import os

import duckdb
import pytest

from leafwise.plans import queries as _queries  # noqa: F401
from leafwise.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    want = sql.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    key = lambda r: repr(tuple(map(plain, r)))
    assert sorted(map(key, rows)) == sorted(key([r[i] for i in at]) for r in want.fetchall())


def test_fallback_without_broadcast(spark):
    """At 9 million documents a broadcast of their ids doesn't fit a driver of 750 MB."""
    df = QUERIES["leg_fallback"](spark, DATA)
    assert df.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan
