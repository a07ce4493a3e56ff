"""Every named query against its SQL on the smallest tables, and its plan."""

import pytest
from compare import database, difference
from oracles.sql import ORACLES as CHECKS
from talkmill.plans.catalog import QUERIES

NO_SQL = set()


@pytest.fixture(scope="module")
def con(data):
    return database(data)


def test_every_query_has_sql_but_the_approximate_ones():
    assert set(QUERIES) - set(CHECKS) == NO_SQL
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert difference(df, con, CHECKS[name]) == ""


def test_lookup_filter_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["language_dist"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan
