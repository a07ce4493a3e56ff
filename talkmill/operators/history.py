"""Message history, conversations of users, deletes and inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import iso_utc


def newest(ts: str, tie: str) -> list[Column]:
    """Newest first; a missing time counts as newest, equal times by higher id."""
    return [F.desc_nulls_first(ts), F.desc(tie)]


def _newest_key(ts: str, tie: str) -> Column:
    """The same order as :func:`newest` for ``max_by``."""
    return F.struct(F.col(ts).isNull(), F.col(ts), F.col(tie))


def users_page(users: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return users.orderBy("id").offset(offset).limit(limit)


def user_by_phone(users: DataFrame, phone_number: str) -> DataFrame:
    return users.where(F.col("phone_number") == phone_number).limit(1)


def user_dicts(users: DataFrame) -> DataFrame:
    """Users as plain text fields, as an API returns them."""
    return users.select(
        F.col("id").cast("string").alias("id"),
        "phone_number", "name", "preferred_language", "location", "farm_size",
        F.array_join("crops", ",").alias("crops"),
        iso_utc(F.col("created_at")).alias("created_at"),
        iso_utc(F.col("last_active_at")).alias("last_active_at"),
        "is_active",
    )


def message_dicts(messages: DataFrame) -> DataFrame:
    """Messages as plain text fields, as an API returns them."""
    return messages.select(
        *[F.col(name).cast("string").alias(name) for name in ("id", "conversation_id", "user_id")],
        "message_type", "direction", "content", "transcribed_text", "language",
        iso_utc(F.col("created_at")).alias("created_at"),
    )


def conversation_dicts(conversations: DataFrame) -> DataFrame:
    """Conversations as plain text fields, as an API returns them."""
    return conversations.select(
        *[F.col(name).cast("string").alias(name) for name in ("id", "user_id")],
        iso_utc(F.col("started_at")).alias("started_at"),
        iso_utc(F.col("ended_at")).alias("ended_at"),
        "message_count", "is_active",
    )


def session_dicts(sessions: DataFrame) -> DataFrame:
    """Sessions as plain text fields, as an API returns them."""
    return sessions.select(
        *[F.col(name).cast("string").alias(name) for name in ("id", "user_id", "conversation_id")],
        *[iso_utc(F.col(name)).alias(name) for name in ("started_at", "last_activity_at")],
        "is_active",
    )


def analytics_dicts(analytics: DataFrame) -> DataFrame:
    """Analytics events as plain text fields, as an API returns them."""
    return analytics.select(
        F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "event_type",
        "event_data", iso_utc(F.col("created_at")).alias("created_at"),
    )


def history_of(messages: DataFrame, user: DataFrame, limit: int = 10) -> DataFrame:
    """Newest messages of the one user in ``user``."""
    return (
        messages.join(user.select(F.col("id").alias("user_id")), "user_id", "left_semi")
        .orderBy(*newest("created_at", "id"))
        .limit(limit)
    )


def latest_per_key(rows: DataFrame, key: str, limit: int, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``limit`` rows of every key with their ``rank``.

    Spark cuts each input partition to ``limit`` rows per key before the
    shuffle, so a key with very many rows does not travel whole.
    """
    window = Window.partitionBy(key).orderBy(*newest(ts, tie))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def last_message(conversations: DataFrame, messages: DataFrame, *keep: str) -> DataFrame:
    """Every conversation with its newest message and the columns ``keep``; nulls where it has none."""
    newest_message = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max_by(F.struct("content", "created_at"), _newest_key("created_at", "id")).alias("m")
    )
    return conversations.join(newest_message, "id", "left").select(
        F.col("id").alias("conversation_id"),
        "user_id", "started_at", "message_count",
        F.col("m.content").alias("last_message"),
        F.col("m.created_at").alias("last_message_at"),
        *keep,
    )


def recent_conversations(conversations: DataFrame, messages: DataFrame, limit: int = 10) -> DataFrame:
    """For every user the newest ``limit`` conversations with their last message."""
    recent = latest_per_key(conversations, "user_id", limit, ts="started_at")
    return last_message(recent, messages, "rank")


def children(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows that belong to the parents, by foreign key ``key``."""
    return rows.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def user_overview(
    users: DataFrame, conversations: DataFrame, messages: DataFrame, sessions: DataFrame, preferences: DataFrame
) -> DataFrame:
    """How many conversations, messages and sessions each user leads to, and
    whether the user has preferences."""
    parts = {"conversations": conversations, "messages": messages, "sessions": sessions, "preferences": preferences}
    overview = users.select(F.col("id").alias("user_id"))
    for name, rows in parts.items():
        overview = overview.join(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias(name)), "user_id", "left")
    return overview.select(
        "user_id",
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in parts if name != "preferences"],
        F.col("preferences").isNotNull().alias("has_preferences"),
    )


def cascade_delete(
    doomed: DataFrame, users: DataFrame, conversations: DataFrame, dependants: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Remove users (ids in ``doomed``) with everything that hangs on them.

    Dependants go with their user or, where they name one, with their conversation.
    """
    gone_users = doomed.select(F.col("id").alias("user_id"))
    gone_conversations = children(doomed, conversations, "user_id").select(F.col("id").alias("conversation_id"))
    kept = {
        "users": users.join(doomed.select("id"), "id", "left_anti"),
        "conversations": conversations.join(gone_users, "user_id", "left_anti"),
    }
    for name, rows in dependants.items():
        rows = rows.join(gone_users, "user_id", "left_anti")
        if "conversation_id" in rows.columns:
            rows = rows.join(gone_conversations, "conversation_id", "left_anti")
        kept[name] = rows
    return kept


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows plus the incoming rows whose key is new; of several incoming
    rows with one key the first by ``order`` is taken."""
    columns = [name for name in incoming.columns if name != key]
    first = (
        incoming.groupBy(key)
        .agg(F.min_by(F.struct(*columns), F.col(order)).alias("row"))
        .select(key, "row.*")
        .join(existing.select(key), key, "left_anti")
    )
    return existing.unionByName(first, allowMissingColumns=True)
