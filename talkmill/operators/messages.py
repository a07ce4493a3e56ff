"""Inbound messages: routing, commands and upload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import kilobytes, strip

# Fixed values.
GROUP_MARK = "@g.us"
BROADCAST_MARK = "status@broadcast"
VOICE_TYPES = ("ptt", "audio", "voice")
WELCOME_COMMANDS = ("/start", "hello", "hi")
HELP_COMMANDS = ("/help",)
AUDIO_TYPES = (
    "audio/ogg", "audio/mpeg", "audio/wav", "audio/x-wav", "audio/mp3", "audio/mp4", "audio/m4a", "audio/x-m4a",
    "audio/aac", "audio/flac", "audio/webm",
)
MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def route_messages(inbound: DataFrame) -> DataFrame:
    """Drop group and broadcast traffic; ``route`` is voice or text."""
    personal = ~F.contains("sender", F.lit(GROUP_MARK)) & ~F.contains("sender", F.lit(BROADCAST_MARK))
    voice = F.col("has_media") & F.col("type").isin(*VOICE_TYPES)
    return inbound.where(personal).withColumn("route", F.when(voice, "voice").otherwise("text"))


def classify_command(routed: DataFrame) -> DataFrame:
    """Add ``command``: welcome, help or question (text route only)."""
    body = F.lower(strip(F.coalesce(F.col("body"), F.lit(""))))
    return routed.withColumn(
        "command",
        F.when(F.col("route") != "text", F.lit(None).cast("string"))
        .when(body.isin(*WELCOME_COMMANDS), "welcome")
        .when(body.isin(*HELP_COMMANDS), "help")
        .otherwise("question"),
    )


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Add ``verdict`` (accepted, unsupported_format, too_large) and ``size_kb``.

    A missing or empty content type passes the format check.
    """
    declared = F.coalesce(F.col("content_type"), F.lit(""))
    base = strip(F.split_part(declared, F.lit(";"), F.lit(1)))
    return uploads.withColumns(
        {
            "base_type": base,
            "size_kb": kilobytes(F.col("size_bytes")),
            "verdict": F.when((declared != "") & ~base.isin(*AUDIO_TYPES), "unsupported_format")
            .when(F.col("size_bytes") > MAX_UPLOAD_BYTES, "too_large")
            .otherwise("accepted"),
        }
    )
