"""Every registered query of the time-series engine against its SQL."""

import math
from numbers import Number

import duckdb
import pandas as pd
import pytest

from tidewater import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if hasattr(x, "year"):
        return str(pd.Timestamp(x).date())
    return f"{round(float(x), 6) + 0.0:.6f}" if isinstance(x, Number) and not isinstance(x, bool) else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.execute(plans.oracle_sql()[name]).df())
