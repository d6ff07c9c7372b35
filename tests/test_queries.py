"""Every query with SQL gives the same rows in DuckDB."""

import glob
import math

import duckdb
import pytest

from cubeloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
