"""Every registered query against its SQL, on the smallest tables."""

import os
import re

import pytest
from check_oracles import compare, views

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["churn_label_window"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "struct<o_custkey:bigint,o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_samples_keep_few_rows_before_the_shuffle(spark):
    plan = plan_of(QUERIES["column_samples"](spark, FOLDER))
    assert "row_number(), 5, Partial" in plan


@pytest.mark.parametrize("name", ["days_since_prev_order", "first_order_flag", "interpurchase_gaps", "session_counts"])
def test_rows_of_one_key_are_never_sent_to_one_task_unreduced(spark, name):
    """Every exchange on the key alone sits above an aggregation."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(QUERIES[name](spark, FOLDER)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    on_key = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\((o_custkey|user_id)#\d+L, \d+\)", line)]
    assert name == "first_order_flag" or on_key
    assert all(re.search("Aggregate|Project", lines[i + 1]) for i in on_key)
    assert all(any("Aggregate" in line for line in lines[i + 1 : i + 4]) for i in on_key)


@pytest.fixture(scope="module")
def connection():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert compare(frame, connection, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3, 4]
    assert sum(r["size"] for r in rows) == 150
    assert all(0 < r["cohesion"] <= 1 and -1 <= r["silhouette"] <= 1 for r in rows)
