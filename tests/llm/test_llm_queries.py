"""The registered queries of the subpackage against their SQL, and the plans of those that must stay in the JVM."""

import pytest
from __spark_entry__ import oracle_sql, queries
from compare import database, difference

from talkmill.llm.catalog import ORACLES, QUERIES


def test_all_are_registered():
    names = [name for name in queries() if name.startswith("op") and name[2].isdigit()]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in queries() and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, database(data), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_chat_format", "op6_pii"])
def test_native_queries_run_no_python(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
