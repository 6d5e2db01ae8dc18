"""Registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tallyspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return "None"
        x = x.item() if hasattr(x, "item") else x
        return repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(value, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_without_sql(spark, duck, name):
    """Brute-force tests cover their operators; here they run on the tables."""
    assert catalog.QUERIES[name](spark, DATA).count() > 0
