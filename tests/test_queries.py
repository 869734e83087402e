"""Every query with SQL gives the same rows in both engines, on the smallest test data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = {k: s for k, s in E.oracle_sql().items()}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canon(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = E.queries()[name](spark, DATA)
    rel = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(canon, r)) for r in df.collect()) == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0
