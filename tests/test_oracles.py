"""Every query of the engine's own operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tomeforge.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return str([plain(y) for y in x])
    if x is None or pd.isna(x):
        return None
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    ours, theirs = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_plans_push_filters_and_prune_columns(spark):
    plan = registry.queries()["gc_anti_grace"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in plan
    assert "l_tax" not in plan


def test_head_revision_with_keys_that_outweigh_balances(spark, tmp_path):
    """Keys of tens of thousands weigh more than a cent; without a balance or a key a row is no head."""
    customers = [("A", 60_000, 9999.80), ("A", 45_000, 9999.79), ("A", 7, 9999.70), ("B", 500_000, -1.25), ("B", 3, -1.5), ("C", 1, None), ("D", 2, 0.0), ("D", None, 5.0)]
    spark.createDataFrame(customers, "c_mktsegment string, c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    ours, theirs = registry.queries()["head_revision_argmax"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["head_revision_argmax"]).df()
    assert rows(ours) == rows(theirs) and dict(ours.values)["A"] == 45_000
