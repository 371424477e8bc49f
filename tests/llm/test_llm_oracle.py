"""Queries of the training-data operators that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from locusframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[columns].astype(object).values.tolist())
    assert [tuple(x.removesuffix(".0") for x in r) for r in rows(got)] == [tuple(x.removesuffix(".0") for x in r) for r in rows(want)]
