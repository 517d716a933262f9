"""Every registered query of the library proper against its SQL on the smallest tables; plans that must keep their shape."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return "~"
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return str([plain(y) for y in x])
    if isinstance(x, bool) or "bool" in type(x).__name__:
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return f"{float(x):.6g}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.registry.ORACLE_SQL))
def test_query(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["exclusion_list", "queue_with_latest_route", "not_applied_anti", "unknown_words"])
def test_joins_are_equi_joins(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
