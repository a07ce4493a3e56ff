"""The model for SQL users: views over the tables, the statistics view, and two table functions.

    register(spark, users, conversations, messages)
    spark.sql("SELECT * FROM active_user_stats")
    spark.sql("SELECT * FROM get_user_recent_conversations(42, 10)")
    spark.sql("SELECT u.id, r.* FROM users u LEFT JOIN LATERAL get_user_recent_conversations(u.id, 3) r")
    spark.sql("SELECT * FROM search_similar_messages(array(0.1, 0.2), NULL, 5)")

The functions are SQL, so Catalyst inlines them: their arguments reach the scans
as filters, and a call for every user becomes joins and one window, not a call
per row. They follow the session they are registered in. Names and columns are
those of the relational service this replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators import stats


def _recent_conversations(prefix: str, user_type: str, id_type: str) -> str:
    """The conditions stand outside, where a call for every user turns them into a join; Catalyst moves them to the
    conversations, below the join. Messages are reduced to one per conversation in each task, so a very long
    conversation does not travel."""
    return f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}get_user_recent_conversations(
            p_user_id {user_type}, p_limit INT DEFAULT 10)
        RETURNS TABLE (conversation_id {id_type}, started_at TIMESTAMP_NTZ, message_count BIGINT,
                       last_message STRING, last_message_at TIMESTAMP_NTZ)
        RETURN
            SELECT id, started_at, message_count, newest.content, newest.created_at
            FROM (
                SELECT id, user_id, started_at, message_count,
                       row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC NULLS FIRST, id DESC) AS place
                FROM {prefix}conversations)
            LEFT JOIN (
                SELECT conversation_id, max_by(struct(content, created_at), struct(created_at IS NULL, created_at, id)) AS newest
                FROM {prefix}messages GROUP BY conversation_id) ON conversation_id = id
            WHERE user_id = p_user_id AND place <= p_limit
    """


_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (total, x) -> total + x)"


def _similar_messages(prefix: str, user_type: str, id_type: str) -> str:
    """Cosine similarity as a column expression; each task keeps its best of 32 shares, then one ranks what is left."""
    lengths = f"sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('p_embedding', 'p_embedding')})"
    return f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}search_similar_messages(
            p_embedding ARRAY<FLOAT>, p_user_id {user_type} DEFAULT NULL, p_limit INT DEFAULT 5)
        RETURNS TABLE (message_id {id_type}, content STRING, similarity DOUBLE)
        RETURN
            SELECT id, content, round(1 - distance, 6)
            FROM (
                SELECT id, content, distance, row_number() OVER (ORDER BY distance, id) AS place
                FROM (
                    SELECT id, content, distance,
                           row_number() OVER (PARTITION BY pmod(hash(id), 32) ORDER BY distance, id) AS near
                    FROM (
                        SELECT id, content, round(1 - try_divide({_DOT.format('embedding', 'p_embedding')}, {lengths}), 6) AS distance
                        FROM {prefix}messages
                        WHERE embedding IS NOT NULL AND (p_user_id IS NULL OR user_id = p_user_id))
                    WHERE distance IS NOT NULL)
                WHERE near <= p_limit)
            WHERE place <= p_limit
    """


def register(
    spark: SparkSession, users: DataFrame, conversations: DataFrame, messages: DataFrame,
    as_of: Column | None = None, prefix: str = "",
) -> None:
    """Register the tables as views users, conversations and messages, the view
    active_user_stats, and the functions get_user_recent_conversations and
    search_similar_messages, all in this session and with ``prefix``.

    ``messages`` may lack ``embedding``; then nothing is similar. ``as_of`` is the
    statistics' time, by default the time of each query. A vector without
    direction is similar to nothing. Without a user, all messages are searched.
    """
    if "embedding" not in messages.columns:
        messages = messages.withColumn("embedding", F.lit(None).cast("array<float>"))
    for name, rows in (("users", users), ("conversations", conversations), ("messages", messages)):
        rows.createOrReplaceTempView(f"{prefix}{name}")
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    stats.active_user_stats(users, conversations, messages, as_of=now).createOrReplaceTempView(f"{prefix}active_user_stats")
    user_type = conversations.schema["user_id"].dataType.simpleString()
    spark.sql(_recent_conversations(prefix, user_type, conversations.schema["id"].dataType.simpleString()))
    spark.sql(_similar_messages(prefix, user_type, messages.schema["id"].dataType.simpleString()))
