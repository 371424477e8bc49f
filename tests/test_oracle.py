"""Every population-genomics query against its SQL in DuckDB, over the smallest driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from locusframe.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if pd.isna(value):
        return ""
    return f"{value + 0.0:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(canonical(v) for v in r) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(ORACLES):
        assert registry.queries()[name](spark, SF).count() > 0
