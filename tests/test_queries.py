"""Every registered query with SQL gives what the SQL gives; the others run."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(str(tuple(value(v) for v in row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        expected = duck.sql(SQL[name]).df()
        assert sorted(df.columns) == sorted(expected.columns) and plain(df) == plain(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(SQL) <= set(QUERIES)
