"""Usage statistics. Counts are taken per key before any join, so no join fans out
and a key that holds a large share of the rows is combined map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_PHONE = "system"


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def _message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("user_id").agg(
        F.count("id").alias("messages"),
        F.count_if(F.col("direction") == "incoming").alias("incoming"),
        F.count_if(F.col("message_type") == "voice").alias("voice"),
        F.count_if(F.col("message_type") == "text").alias("text"),
    )


def _with_counts(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Users with their conversation and message counts; one row per user."""
    per_conversation = conversations.groupBy("user_id").agg(F.count("id").alias("conversations"))
    counts = ["conversations", "messages", "incoming", "voice", "text"]
    return (
        users.withColumnRenamed("id", "user_id")
        .join(per_conversation, "user_id", "left")
        .join(_message_counts(messages), "user_id", "left")
        .withColumns({name: _zero(name) for name in counts})
    )


def user_stats(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Statistics of every user. ``text_messages`` is incoming minus voice of
    either direction, so it can be negative."""
    return _with_counts(users, conversations, messages).select(
        "user_id",
        "phone_number",
        F.col("created_at").alias("member_since"),
        F.col("last_active_at").alias("last_active"),
        F.col("conversations").alias("total_conversations"),
        F.col("incoming").alias("total_messages"),
        F.col("voice").alias("voice_messages"),
        (F.col("incoming") - F.col("voice")).alias("text_messages"),
        "preferred_language",
    )


def overall_stats(users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Table totals in one row, the system user included; one scan per table."""
    return messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("message_type") == "voice").alias("voice_messages"),
        F.count_if(F.col("message_type") == "text").alias("text_messages"),
    ).withColumns(
        {
            "total_users": users.agg(F.count(F.lit(1))).scalar(),
            "total_conversations": conversations.agg(F.count(F.lit(1))).scalar(),
        }
    )


def active_user_stats(
    users: DataFrame, conversations: DataFrame, messages: DataFrame, as_of: Column, fan_out: bool = True
) -> DataFrame:
    """Totals over all users but the system one, as of a point in time.

    With ``fan_out`` the message counts are those of the join of users with
    both conversations and messages, where each message is seen once per
    conversation of its user. That equals messages x max(conversations, 1) per
    user, so the join itself is never built.
    """
    seen = F.greatest(F.col("conversations"), F.lit(1)) if fan_out else F.lit(1)
    last = F.col("last_active_at")
    active = {"active_last_24h": "24 HOURS", "active_last_7d": "7 DAYS", "active_last_30d": "30 DAYS"}
    return (
        _with_counts(users.where(F.col("phone_number") != SYSTEM_PHONE), conversations, messages)
        .withColumn("_as_of", as_of)
        .agg(
            F.count("user_id").alias("total_users"),
            *[F.count_if(last > F.col("_as_of") - F.expr(f"INTERVAL {span}")).alias(name) for name, span in active.items()],
            F.coalesce(F.sum("conversations"), F.lit(0)).alias("total_conversations"),
            F.coalesce(F.sum(F.col("messages") * seen), F.lit(0)).alias("total_messages"),
            F.coalesce(F.sum(F.col("voice") * seen), F.lit(0)).alias("voice_messages"),
            F.coalesce(F.sum(F.col("text") * seen), F.lit(0)).alias("text_messages"),
        )
    )


def language_distribution(messages: DataFrame) -> DataFrame:
    """Messages per language; a missing language is a key of its own."""
    return messages.groupBy("language").agg(F.count(F.lit(1)).alias("messages"))


def type_direction_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("message_type", "direction").agg(F.count(F.lit(1)).alias("messages"))


def messages_per_conversation(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"))


def counter_drift(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations whose stored message counter differs from the messages held."""
    actual = messages_per_conversation(messages).select(
        F.col("conversation_id").alias("id"), F.col("message_count").alias("actual_count")
    )
    return (
        conversations.select("id", F.col("message_count").cast("long").alias("stored_count"))
        .join(actual, "id", "left")
        .withColumn("actual_count", _zero("actual_count"))
        .where(~F.col("stored_count").eqNullSafe(F.col("actual_count")))
        .withColumnRenamed("id", "conversation_id")
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
