"""State derived from a message log: users, conversations, sessions, profiles.

Snapshots are immutable: every upsert is a function from snapshot and log to
the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log_summary(log: DataFrame) -> DataFrame:
    """One row per phone: first name, first and last time, last known language."""
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    known = F.when(F.col("language").isNotNull(), last)
    return log.groupBy("phone_number").agg(
        F.min_by("name", first).alias("first_name"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max_by("language", known).alias("last_language"),
    )


def upsert_users(users: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """Users after a message log: new phones become users, known ones only move
    ``last_active_at``. A new user keeps the name of the first message."""
    summary = _log_summary(log)
    is_new = F.col("id").isNull()
    touched = F.col("first_seen").isNotNull()
    return (
        users.select("id", "phone_number", "name", "preferred_language", "created_at", "updated_at", "last_active_at")
        .join(summary, "phone_number", "full")
        .withColumn("_as_of", as_of)
        .select(
            "phone_number",
            F.when(is_new, F.col("first_name")).otherwise(F.col("name")).alias("name"),
            F.when(is_new, F.coalesce("last_language", F.lit("en"))).otherwise(F.col("preferred_language")).alias("preferred_language"),
            F.when(is_new, F.col("first_seen")).otherwise(F.col("created_at")).alias("created_at"),
            F.when(touched, F.col("_as_of")).otherwise(F.col("updated_at")).alias("updated_at"),
            F.when(touched, F.col("last_seen")).otherwise(F.col("last_active_at")).alias("last_active_at"),
            is_new.alias("is_new"),
        )
    )


def user_created_events(upserted: DataFrame) -> DataFrame:
    """One event per newly created user, with a JSON payload that keeps null names."""
    payload = F.to_json(F.struct("phone_number", "name"), {"ignoreNullFields": "false"})
    return upserted.where("is_new").select(
        "phone_number", F.lit("user_created").alias("event_type"), payload.alias("event_data"), "created_at"
    )


def assign_conversation(users: DataFrame, conversations: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Every user's conversation: the newest active one, else a new one."""
    newest = F.struct(F.col("started_at").isNull(), F.col("started_at"), F.col("id"))
    active = (
        conversations.where("is_active").groupBy("user_id").agg(F.max_by("id", newest).alias("existing"))
    )
    fresh = F.expr("uuid()") if new_id is None else new_id
    return (
        users.select(F.col("id").alias("user_id"))
        .join(active, "user_id", "left")
        .select(
            "user_id",
            F.when(F.col("existing").isNotNull(), F.col("existing")).otherwise(fresh).alias("conversation_id"),
            F.col("existing").isNull().alias("is_new"),
        )
    )


def sessionise(messages: DataFrame, gap: str = "30 minutes", ttl: str = "30 minutes") -> DataFrame:
    """Sessions of every user: a pause longer than ``gap`` starts a new one.

    Messages are first reduced to one row per user and gap-wide time slot.
    Messages within a slot are never further apart than the gap, so a slot
    never has to be split, and a user with very many messages is left with at
    most one row per slot.
    """
    slots = messages.groupBy("user_id", F.window("created_at", gap).start.alias("slot")).agg(
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )
    by_time = Window.partitionBy("user_id").orderBy("slot")
    previous = F.lag("last_at").over(by_time)
    starts = previous.isNull() | (F.col("first_at") > previous + F.expr(f"INTERVAL {gap}"))
    return (
        slots.withColumn("_starts", starts.cast("int"))
        .withColumn("session_no", F.sum("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("user_id", "session_no")
        .agg(
            F.min("first_at").alias("started_at"),
            F.max("last_at").alias("last_activity_at"),
            F.sum("n").alias("messages"),
        )
        .withColumn("expires_at", F.col("last_activity_at") + F.expr(f"INTERVAL {ttl}"))
    )


def count_saved_messages(conversations: DataFrame, saved: DataFrame) -> DataFrame:
    """Conversations with their stored counter raised by the messages just saved."""
    added = saved.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("_added"))
    raised = F.coalesce("message_count", F.lit(0)) + F.coalesce("_added", F.lit(0))
    return conversations.join(added, "id", "left").withColumn("message_count", raised).drop("_added")


def language_changes(users: DataFrame, detections: DataFrame) -> DataFrame:
    """Users whose newest detected language differs from the preferred one."""
    latest = (
        detections.where(F.col("language").isNotNull())
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.max_by("language", F.struct("created_at", "id")).alias("new_language"))
    )
    return (
        users.select("id", F.col("preferred_language").alias("old_language"))
        .join(latest, "id")
        .where(~F.col("old_language").eqNullSafe(F.col("new_language")))
        .withColumnRenamed("id", "user_id")
    )


def apply_language_changes(users: DataFrame, detections: DataFrame, as_of: Column) -> DataFrame:
    """Users with the newest detected language as the preferred one; a user that
    changes gets a new ``updated_at``."""
    changes = language_changes(users, detections).select(F.col("user_id").alias("id"), "new_language")
    changed = F.col("new_language").isNotNull()
    return (
        users.join(changes, "id", "left")
        .withColumn("_as_of", as_of)
        .withColumns(
            {
                "preferred_language": F.coalesce("new_language", "preferred_language"),
                "updated_at": F.when(changed, F.col("_as_of")).otherwise(F.col("updated_at")),
            }
        )
        .drop("_as_of", "new_language")
    )


def patch_profiles(users: DataFrame, patches: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Apply the non-empty fields of all patches of a user; a row that really
    changes gets a new ``updated_at``.

    Of several patches the last non-empty value of each field wins, by the
    column ``order``; without one, or on a tie, the largest value.
    """
    fields = ["name", "location", "farm_size", "crops"]

    def last(name: str) -> Column:
        filled = F.size(name) > 0 if name == "crops" else F.col(name) != ""
        rank = F.struct(*([order] if order else []), name)
        return F.max_by(name, F.when(filled, rank)).alias(f"_{name}")

    patch = patches.groupBy(F.col("user_id").alias("id")).agg(*[last(name) for name in fields])
    new = {name: F.coalesce(F.nullif(F.col(f"_{name}"), F.lit("")), F.col(name)) for name in fields[:-1]}
    new["crops"] = F.when(F.size("_crops") > 0, F.col("_crops")).otherwise(F.col("crops"))
    changed = F.lit(False)
    for name, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(name))
    return (
        users.join(patch, "id", "left")
        .withColumn("_as_of", as_of)
        .withColumns({**new, "updated_at": F.when(changed, F.col("_as_of")).otherwise(F.col("updated_at"))})
        .drop("_as_of", *[f"_{name}" for name in fields])
    )


def latest_state(answered: DataFrame, key: str = "sender", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest answered message of every sender: body, response, route and time.

    Only messages that got a ``response`` change the state: greetings and help
    requests are replied to without touching it.
    """
    return answered.where(F.col("response").isNotNull()).groupBy(key).agg(
        F.max_by(F.struct("body", "response", "route", ts), F.struct(ts, tie)).alias("s")
    ).select(
        key,
        F.col("s.body").alias("last_message"),
        F.col("s.response").alias("last_response"),
        F.col("s.route").alias("message_type"),
        F.col(f"s.{ts}").alias("last_at"),
    )
