"""The streaming jobs: ingest, activity, sessions, latest state, repeats.

All take a stream with an event-time column ``ts`` and use a watermark of ten
minutes: rows later than that are dropped, and a window is written once the
watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.language import detect_language
from talkmill.functions.text import normalise_sender
from talkmill.operators.messages import classify_command, route_messages, validate_uploads
from talkmill.sources.views import inbound
from talkmill.streaming.runner import WATERMARK
from talkmill.streaming.state import ChangeTable, changes


def ingest(events: DataFrame) -> DataFrame:
    """Inbound events to message rows: routed, classified, language detected.

    Greetings and help requests are answered at once and not stored. A voice
    message is stored only if its upload (``content_type``, ``size_bytes``) is accepted.
    """
    routed = classify_command(route_messages(inbound(events))).where(
        F.col("command").isNull() | (F.col("command") == "question")
    )
    routed = validate_uploads(routed).where((F.col("route") != "voice") | (F.col("verdict") == "accepted"))
    known = detect_language(routed.withColumn("content", F.coalesce("body", F.lit(""))), "content")
    return known.select(
        F.col("event_id").alias("id"),
        normalise_sender(F.col("sender")).alias("phone_number"),
        F.when(F.col("route") == "voice", "voice").otherwise("text").alias("message_type"),
        F.lit("incoming").alias("direction"),
        "content", "language", "confidence", "command",
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def activity(events: DataFrame, sender: str = "user_id", width: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """Messages and distinct senders per window.

    Senders are first counted per window and sender, which keeps the count
    exact and spreads a busy window over many tasks.
    """
    per_sender = (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width), sender).agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_sender.groupBy(F.window("window", width).alias("w"))
        .agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("active_senders"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "messages", "active_senders")
    )


def active_sliding(
    events: DataFrame, user: str = "user_id", width: str = "24 hours", slide: str = "1 hour", delay: str = WATERMARK
) -> DataFrame:
    """Distinct users per sliding window.

    Users are first counted per window and user, so that the second count is
    exact and a window's users are spread over many tasks.
    """
    per_user = (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), user).agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_user.groupBy("window")
        .agg(F.count(F.lit(1)).alias("active_users"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "active_users")
    )


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """Sessions per user, written when the watermark passes their end."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(user, F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("messages"), F.max("ts").alias("last_activity_at"))
        .select(
            user,
            F.col("s.start").cast("timestamp_ntz").alias("started_at"),
            F.col("last_activity_at").cast("timestamp_ntz").alias("last_activity_at"),
            F.col("s.end").cast("timestamp_ntz").alias("expires_at"),
            "messages",
        )
    )


def without_repeats(events: DataFrame, key: str = "event_id", delay: str = WATERMARK) -> DataFrame:
    """Each key once within the watermark; the state of older keys is let go."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def follow_state(
    spark: SparkSession, routed: DataFrame, path: str, ttl_seconds: int = 24 * 3600, delay: str = WATERMARK
) -> ChangeTable:
    """Run the stateful stream of :mod:`talkmill.streaming.state` over what is available, into a table of changes."""
    kept = ChangeTable(spark, path)
    query = (
        changes(routed, ttl_seconds, delay)
        .writeStream.outputMode("update")
        .foreachBatch(kept.add)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return kept


def latest_state(
    spark: SparkSession, routed: DataFrame, path: str, ttl_seconds: int = 24 * 3600, delay: str = WATERMARK
) -> DataFrame:
    """The newest answered message of every sender, kept up to date by a stream.

    A sender is ``expired`` when the time to live has passed since, by the newest event seen.
    """
    state = follow_state(spark, routed, path, ttl_seconds, delay).read()
    now = state.agg(F.max("us")).scalar()
    return state.select(
        "sender",
        F.col("body").alias("last_message"),
        F.col("response").alias("last_response"),
        F.col("route").alias("message_type"),
        F.timestamp_micros("us").cast("timestamp_ntz").alias("last_at"),
        (F.col("us") + ttl_seconds * 1_000_000 < now).alias("expired"),
    )


def expired_senders(
    spark: SparkSession, routed: DataFrame, path: str, ttl_seconds: int = 24 * 3600, delay: str = WATERMARK
) -> DataFrame:
    """(sender, last_message, last_at): the senders whose timer has run out, that is, whose time to live ended before
    the watermark, and who were not heard of since."""
    gone = follow_state(spark, routed, path, ttl_seconds, delay).read().where("expired")
    return gone.select(
        "sender", F.col("body").alias("last_message"), F.timestamp_micros("us").cast("timestamp_ntz").alias("last_at")
    )
