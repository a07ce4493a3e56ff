"""Schemas of the relational model and of the semi-structured inputs."""

from __future__ import annotations

from pyspark.sql import types as T

LANGUAGES = ("en", "tw", "ga", "ee", "dag")
MESSAGE_TYPES = ("text", "voice", "system")
DIRECTIONS = ("incoming", "outgoing")

_ts = T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


USERS = _struct(
    ("id", T.LongType(), False),
    ("phone_number", T.StringType(), False),
    ("name", T.StringType()),
    ("preferred_language", T.StringType()),
    ("location", T.StringType()),
    ("farm_size", T.StringType()),
    ("crops", T.ArrayType(T.StringType())),
    ("created_at", _ts),
    ("updated_at", _ts),
    ("last_active_at", _ts),
    ("metadata", T.StringType()),
    ("is_active", T.BooleanType()),
)

CONVERSATIONS = _struct(
    ("id", T.LongType(), False),
    ("user_id", T.LongType()),
    ("started_at", _ts),
    ("ended_at", _ts),
    ("message_count", T.IntegerType()),
    ("is_active", T.BooleanType()),
    ("metadata", T.StringType()),
)

MESSAGES = _struct(
    ("id", T.LongType(), False),
    ("conversation_id", T.LongType()),
    ("user_id", T.LongType()),
    ("message_type", T.StringType(), False),
    ("direction", T.StringType(), False),
    ("content", T.StringType(), False),
    ("transcribed_text", T.StringType()),
    ("language", T.StringType()),
    ("audio_file_path", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
    ("created_at", _ts),
    ("metadata", T.StringType()),
)

SESSIONS = _struct(
    ("id", T.StringType(), False),
    ("user_id", T.LongType()),
    ("conversation_id", T.LongType()),
    ("session_token", T.StringType()),
    ("started_at", _ts),
    ("last_activity_at", _ts),
    ("expires_at", _ts),
    ("is_active", T.BooleanType()),
    ("metadata", T.StringType()),
)

USER_PREFERENCES = _struct(
    ("id", T.LongType(), False),
    ("user_id", T.LongType()),
    ("receive_notifications", T.BooleanType()),
    ("notification_time", T.StringType()),
    ("topics_of_interest", T.ArrayType(T.StringType())),
    ("preferences", T.StringType()),
    ("created_at", _ts),
    ("updated_at", _ts),
)

ANALYTICS = _struct(
    ("id", T.LongType(), False),
    ("user_id", T.LongType()),
    ("event_type", T.StringType(), False),
    ("event_data", T.StringType()),
    ("created_at", _ts),
)

KNOWLEDGE_BASE = _struct(
    ("question", T.StringType()),
    ("answer", T.StringType()),
    ("source", T.StringType()),
)

LOG_LINE = _struct(
    ("timestamp", T.StringType()),
    ("level", T.StringType()),
    ("logger", T.StringType()),
    ("message", T.StringType()),
    ("exception", T.StringType()),
    ("request_id", T.StringType()),
    ("duration_ms", T.LongType()),
)

EVENTS = _struct(
    ("event_id", T.LongType()),
    ("ts", _ts),
    ("user_id", T.LongType()),
    ("event_type", T.StringType()),
    ("value", T.DoubleType()),
    ("props", T.StringType()),
)

# Longest value each VARCHAR(n) column of the model accepts.
MAX_LENGTHS = {
    "users": {"phone_number": 20, "name": 255, "preferred_language": 5, "location": 255, "farm_size": 50},
    "messages": {"message_type": 20, "direction": 10, "language": 5},
    "sessions": {"session_token": 255},
    "analytics": {"event_type": 50},
}
