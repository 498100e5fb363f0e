"""Queries that have SQL, against DuckDB, and that every registered query is whole."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tomeforge.llm import registry

SF = "/root/testdata/sf0.01"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_one_query_an_operator():
    names = list(registry.queries())
    assert names == [n for k in range(1, 13) for n in names if n.startswith(f"op{k}_")] + ["pipeline"]
