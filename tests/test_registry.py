"""Every registered query against its SQL on the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import check
from registry import all_queries, all_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()
FITTED = ("kmeans_", "elbow_", "rf_", "model_")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(os.path.join(SF, "*.parquet")):
        table = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert all(name.startswith(FITTED) for name in set(QUERIES) - set(SQL))
    assert {"kmeans_facts", "elbow_facts", "rf_forecast_facts", "rf_importance_facts", "model_roundtrip_facts"} <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    verdict, _, _ = check.compare(spark, con, SF, name, lambda *_: df, SQL[name])
    assert verdict == "match"
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["number", "name", "weekday", "tot_act"]
    assert df.count() > 0
