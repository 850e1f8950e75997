"""Queries against their SQL twins, at the smallest scale; ALL_QUERIES=1 runs every one."""

import os
from collections import Counter

import duckdb
import pytest
from conftest import plan_of

import __spark_entry__ as contract
from tools.check import TABLES, plain

SOME = ["incident_keys", "metric_deviation", "node_pod_map", "error_log_evidence",
        "mine_templates", "status_combinations", "trace_evidence", "upsert_results"]
NAMES = list(contract.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = contract.queries()[name](spark, sf)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())


@pytest.mark.parametrize("name", ["pod_fault_vs_normal", "span_parent_join", "match_templates",
                                  "window_mean_duration", "log_time_range", "hot_deck_fill"])
def test_plans_have_no_nested_loops(spark, sf, name):
    plan = plan_of(contract.queries()[name](spark, sf))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
