"""Every query that has SQL gives DuckDB's rows."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for k in cols:
        df[k] = df[k].astype(float).round(6) if df[k].dtype.kind in "fiu" or str(df[k].dtype).startswith("Int") else df[k].astype(str)
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    a, b = plain(entry.queries()[name](spark, SF).toPandas()), plain(duck.execute(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for k in a.columns:
        assert np.array_equal(a[k], b[k], equal_nan=True) if a[k].dtype == float else (a[k] == b[k]).all(), k


def test_entry(spark):
    assert entry.entry(spark).count() == 64
