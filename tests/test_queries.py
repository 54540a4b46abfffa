"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from pagelode.plans.queries import QUERIES, SQL
from pagelode.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        return v.isoformat() if isinstance(v, pd.Timestamp) else str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers may come as floats where there are nulls
        if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c]):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
