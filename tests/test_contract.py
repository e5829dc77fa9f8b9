"""The entry module on the smallest tables: every query runs, and equals its SQL where there is one."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module


def values(df):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return None if x is None or x is pd.NaT or x is pd.NA else float(x) if isinstance(x, (int,)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(str(plain(x)) for x in row) for row in df.itertuples(index=False)))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_flagship(spark, small):
    assert entry_module.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, small, duck, name):
    got = entry_module.queries()[name](spark, small).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
