"""The SQL views and functions: what they return on hand-made rows, and what their plans read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkmill.plans import sql_surface
from talkmill.session import scratch_path

T0 = dt.datetime(2024, 1, 1)
at = lambda h: T0 + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def model(spark):
    users = spark.createDataFrame(
        [(1, "+1", at(9)), (2, "+2", at(1)), (3, "+3", None), (0, "system", at(9))],
        "id long, phone_number string, last_active_at timestamp_ntz",
    )
    conversations = spark.createDataFrame(
        [(10, 1, at(0), 2), (11, 1, at(5), 0), (12, 1, None, 1), (20, 2, at(1), 1)],
        "id long, user_id long, started_at timestamp_ntz, message_count long",
    )
    messages = spark.createDataFrame(
        [
            (100, 10, 1, "text", "old", at(1), [1.0, 0.0]), (101, 10, 1, "voice", "new", at(2), [0.0, 1.0]),
            (102, 12, 1, "text", "undated", None, [0.0, 0.0]), (103, 12, 1, "text", "dated", at(7), None),
            (200, 20, 2, "text", "other", at(1), [1.0, 1.0]),
        ],
        "id long, conversation_id long, user_id long, message_type string, content string, created_at timestamp_ntz, embedding array<float>",
    ).withColumn("direction", F.lit("incoming"))
    stored = []
    for name, rows in (("users", users), ("conversations", conversations), ("messages", messages)):
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        stored.append(spark.read.parquet(path))
    sql_surface.register(spark, *stored, as_of=F.lit(at(10)), prefix="t_")
    return stored


def rows(spark, statement):
    return [tuple(r) for r in spark.sql(statement).collect()]


def test_recent_conversations_of_one_user(spark, model):
    # an undated start is the newest, an undated message too
    found = rows(spark, "SELECT conversation_id, message_count, last_message FROM t_get_user_recent_conversations(1, 2)")
    assert sorted(found) == [(11, 0, None), (12, 1, "undated")]
    assert len(rows(spark, "SELECT * FROM t_get_user_recent_conversations(1)")) == 3
    assert rows(spark, "SELECT * FROM t_get_user_recent_conversations(3)") == []


def test_a_call_for_every_user_is_joins(spark, model):
    statement = "SELECT u.id, r.conversation_id, r.last_message FROM t_users u LEFT JOIN LATERAL t_get_user_recent_conversations(u.id, 1) r"
    assert sorted(rows(spark, statement)) == [(0, None, None), (1, 12, "undated"), (2, 20, "other"), (3, None, None)]
    plan = spark.sql(statement)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_arguments_reach_the_scan(spark, model):
    plan = spark.sql("SELECT * FROM t_get_user_recent_conversations(2, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,2)" in plan
    plan = spark.sql("SELECT * FROM t_search_similar_messages(array(1.0, 0.0), 2, 3)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,2)" in plan and "IsNotNull(embedding)" in plan
    # each task keeps its best before one ranks them
    assert plan.count("WindowGroupLimit") >= 2
    assert "message_type" not in plan


def test_similar_messages(spark, model):
    found = rows(spark, "SELECT message_id, content, similarity FROM t_search_similar_messages(array(1.0, 0.0), NULL, 5)")
    assert sorted(found, key=lambda r: -r[2]) == [(100, "old", 1.0), (200, "other", 0.707107), (101, "new", 0.0)]
    assert rows(spark, "SELECT message_id FROM t_search_similar_messages(array(1.0, 0.0), 1, 1)") == [(100,)]
    assert rows(spark, "SELECT message_id FROM t_search_similar_messages(array(1.0, 0.0), 3)") == []
    assert rows(spark, "SELECT message_id FROM t_search_similar_messages(array(0.0, 0.0))") == []


def test_statistics_view_and_tables_without_vectors(spark, model):
    found = spark.sql("SELECT * FROM t_active_user_stats").first()
    assert (found.total_users, found.active_last_24h, found.total_conversations, found.total_messages) == (3, 2, 4, 4 * 3 + 1)
    assert "message_type" not in spark.sql("SELECT total_users FROM t_active_user_stats")._jdf.queryExecution().executedPlan().toString()
    sql_surface.register(spark, model[0], model[1], model[2].drop("embedding"), prefix="bare_")
    assert rows(spark, "SELECT * FROM bare_search_similar_messages(array(1.0, 0.0))") == []
    assert spark.sql("SELECT total_messages FROM bare_active_user_stats").first()[0] == 13
