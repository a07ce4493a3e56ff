"""The relational model as views over the base tables.

The base tables are generic (customers, events, documents ...); each view maps
them onto one table of the conversational model. Views are lazy and only name
columns, so a query that needs two columns scans two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.schemas import LANGUAGES
from talkmill.sources.tables import table

HOST_SUFFIX = "@c.us"
GROUP_SUFFIX = "@g.us"
BROADCAST_SENDER = "status@broadcast"


def nth(values: tuple, position: Column) -> Column:
    """``values[position]`` as a CASE; an out-of-range position gives null."""
    picked = F.when(position == 0, F.lit(values[0]))
    for index, value in enumerate(values[1:], start=1):
        picked = picked.when(position == index, F.lit(value))
    return picked


def phone(number: Column) -> Column:
    return F.concat(F.lit("+"), F.lpad(number.cast("string"), 9, "0"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation, events = (table(spark, folder, t) for t in ("customer", "nation", "events"))
    activity = events.groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_active_at")
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.when(F.col("c_custkey") == 0, "system").otherwise(phone(F.col("c_custkey"))).alias("phone_number"),
            F.col("c_name").alias("name"),
            nth(LANGUAGES, F.col("c_nationkey") % 5).alias("preferred_language"),
            F.col("n_name").alias("location"),
            F.col("c_mktsegment").alias("farm_size"),
            F.array(F.lower("c_mktsegment"), F.lower("n_name")).alias("crops"),
            F.lit(True).alias("is_active"),
        )
        .join(activity, "id", "left")
        .withColumn("updated_at", F.col("last_active_at"))
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    voice = F.col("event_type") == "view"
    return events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * 1000 + F.floor((F.dayofmonth("ts") - 1) / 10)).alias("conversation_id"),
        "user_id",
        F.when(voice, "voice").when(F.col("event_type") == "error", "system").otherwise("text").alias("message_type"),
        F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"),
        F.col("props").alias("content"),
        F.when(voice, F.get_json_object("props", "$.k")).alias("transcribed_text"),
        nth(LANGUAGES, F.col("user_id") % 6).alias("language"),
        F.col("ts").alias("created_at"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation headers; the stored counter leaves system notices out."""
    return (
        messages(spark, folder)
        .groupBy(F.col("conversation_id").alias("id"), "user_id")
        .agg(
            F.min("created_at").alias("started_at"),
            F.count_if(F.col("message_type") != "system").alias("message_count"),
        )
        .withColumns({"ended_at": F.lit(None).cast("timestamp_ntz"), "is_active": F.lit(True)})
    )


def message_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "incoming")
        .when(F.col("role") == "assistant", "outgoing")
        .otherwise("system")
        .alias("direction"),
        F.col("text").alias("content"),
    )


def analytics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        "event_type",
        F.col("props").alias("event_data"),
        F.col("ts").alias("created_at"),
    )


def preferences(spark: SparkSession, folder: str) -> DataFrame:
    """Preference rows of the customers in credit."""
    return (
        table(spark, folder, "customer")
        .where(F.col("c_acctbal") > 0)
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("user_id"),
            (F.col("c_acctbal") > 1000).alias("receive_notifications"),
            F.array(F.lower("c_mktsegment")).alias("topics_of_interest"),
        )
    )


def kb(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("answer"), "source"
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("user_id")
    )


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each question with the vector stored under its own id."""
    return questions(spark, folder).join(
        vectors(spark, folder).withColumnRenamed("id", "query_id"), "query_id"
    )


def transliterated(documents: DataFrame) -> DataFrame:
    """Whole documents with five accented letters written as special letters,
    so that the letter rules of the language functions have work to do."""
    return documents.select(
        F.col("doc_id").alias("id"), F.translate("text", "çéñßü", "ɔɛŋɖɣ").alias("text")
    )


def inbound(events: DataFrame) -> DataFrame:
    """Raw inbound messages as a messaging gateway delivers them; ``events`` may be a stream."""
    kind = F.col("event_type")
    number = F.lpad(F.col("user_id").cast("string"), 9, "0")
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 3, F.concat(number, F.lit(GROUP_SUFFIX)))
        .when(F.col("event_id") % 13 == 5, F.lit(BROADCAST_SENDER))
        .otherwise(F.concat(number, F.lit(HOST_SUFFIX)))
        .alias("sender"),
        nth(("/start", " HELLO ", "\n/Help", "hi", "hi there", None), F.col("event_id") % 7).alias("command"),
        F.col("props").alias("payload"),
        F.when(kind == "view", "ptt").when(kind == "click", "audio").when(kind == "signup", "voice")
        .when(kind == "error", "image").otherwise("chat").alias("type"),
        (F.col("event_id") % 5 != 0).alias("has_media"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, F.lit("")).alias("push_name"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("contact "), F.col("user_id").cast("string")))
        .alias("contact_name"),
        *_upload_fields(9),
        "ts",
    ).select(
        "event_id", "sender",
        F.when(F.col("event_id") % 7 == 6, F.col("payload")).otherwise(F.col("command")).alias("body"),
        "type", "has_media", "push_name", "contact_name", "content_type", "size_bytes", "ts",
    )


def _upload_fields(full: int) -> tuple[Column, Column]:
    """Declared content type and size in bytes; events of number ``full`` modulo 17 are just small enough, those after
    them just too large."""
    types = ("audio/ogg; codecs=opus", "audio/mpeg", " audio/wav ;rate=8000", "video/mp4", "audio/x-m4a", "AUDIO/OGG", "")
    size = F.floor(F.col("value") * 100000).cast("long")
    return (
        nth(types, F.col("event_id") % 8).alias("content_type"),
        F.when(F.col("event_id") % 17 == full, F.lit(10485760))
        .when(F.col("event_id") % 17 == full + 1, F.lit(10485761))
        .otherwise(size).alias("size_bytes"),
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Voice uploads: declared content type and size in bytes."""
    return table(spark, folder, "events").select(F.col("event_id").alias("upload_id"), *_upload_fields(0))


def asr_replies(documents: DataFrame) -> DataFrame:
    """Speech-to-text replies wrapped around the transliterated documents."""
    text = F.col("text")
    shape = F.col("id") % 9
    marked = "TRANSCRIPTION:"
    return transliterated(documents).select(
        "id",
        F.when(shape == 0, F.concat(F.lit("LANGUAGE: tw\nTRANSCRIPTION: "), text))
        .when(shape == 1, F.concat(F.lit("  LANGUAGE: Twi (Akan)\n  TRANSCRIPTION:   "), text, F.lit("  ")))
        .when(shape == 2, F.concat(F.lit("LANGUAGE: ga\nTRANSCRIPTION: first\nLANGUAGE: unknown\nTRANSCRIPTION: "), text))
        .when(shape == 3, text)
        .when(shape == 4, F.lit(f"LANGUAGE: en\n{marked} TRANSCRIPTION_FAILED"))
        .when(shape == 5, F.lit("  \n "))
        .when(shape == 6, F.concat(F.lit("LANGUAGE: Dagbani\n"), text))
        .when(shape == 7, F.concat(F.lit("LANGUAGE: EE\nLANGUAGE: DAG LANGUAGE:\nTRANSCRIPTION: TRANSCRIPTION: "), text))
        .otherwise(F.concat(F.lit("LANGUAGE: ewe\nTRANSCRIPTION: "), text, F.lit("\nTRANSCRIPTION:")))
        .alias("reply"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Service log lines; one in ten is not JSON."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    number = F.col("event_id").cast("string")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(
        F.lit('{"timestamp": "'), stamp, F.lit('", "level": "'), level,
        F.lit('", "logger": "service", "message": "'), F.col("event_type"), F.lit(' done"'),
        F.when(F.col("event_type") == "error", F.lit(', "exception": "Traceback\\nValueError"')).otherwise(""),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(', "request_id": "r'), number, F.lit('"'))).otherwise(""),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit(', "duration_ms": '), (F.col("event_id") % 5000).cast("string"))).otherwise(""),
        F.lit("}"),
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 10 == 7, F.concat(F.lit("plain text "), F.col("event_type"))).otherwise(line).alias("line"),
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Per-request stage timings; only voice requests have an ``asr`` stage."""
    rag = (F.col("event_id") % 97).cast("int")
    llm = F.floor(F.col("value") * 10).cast("int")
    asr = (F.col("event_id") % 53 + 100).cast("int")
    voice = F.col("event_type") == "view"
    text_map = F.create_map(F.lit("rag"), rag, F.lit("llm"), llm, F.lit("total"), rag + llm)
    voice_map = F.create_map(F.lit("asr"), asr, F.lit("rag"), rag, F.lit("llm"), llm, F.lit("total"), rag + llm + asr)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), F.when(voice, voice_map).otherwise(text_map).alias("timings_ms")
    )


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Request failures with transport code and message."""
    return table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "voice").otherwise("text").alias("channel"),
        nth((None, "ECONNREFUSED", "ETIMEDOUT", "EPIPE", None, None), F.col("event_id") % 6).alias("code"),
        nth(
            ("timeout of 60000ms exceeded", "connect failed", None, "Unsupported audio format: video/mp4",
             "audio transcription failed", "Request failed with status code 500", "socket hang up"),
            F.col("event_id") % 7,
        ).alias("message"),
    )


def message_log(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming message log keyed by phone, with sender name and detected language.

    Half of its phones are unknown to ``users``.
    """
    return table(spark, folder, "events").select(
        "event_id",
        phone(F.col("user_id") * 20).alias("phone_number"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("sender "), F.col("user_id").cast("string"))).alias("name"),
        nth(LANGUAGES, F.col("event_id") % 6).alias("language"),
        F.col("ts"),
    )


def profile_patches(spark: SparkSession, folder: str) -> DataFrame:
    """One profile patch per supplier, addressed to the user with the same id."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("user_id"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("name"),
        F.when(key % 3 == 0, "North").when(key % 3 == 1, "").alias("location"),
        F.when(key % 5 == 0, "2 acres").alias("farm_size"),
        F.when(key % 2 == 0, F.array(F.lit("maize"), F.lit("rice")))
        .when(key % 3 == 0, F.array().cast("array<string>")).alias("crops"),
    )


def signups(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-up requests; every second one repeats a phone another one used."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("id"), phone(F.floor(key / 2) * 40).alias("phone_number"), F.col("s_name").alias("name"),
        F.lit("en").alias("preferred_language"),
    )


def translation_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Known translations: the questions that carry a label, out of each language."""
    items = table(spark, folder, "benchmark").join(
        table(spark, folder, "labels").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi"
    )
    return items.select(
        F.col("text"),
        F.explode(F.array(*[F.lit(code) for code in LANGUAGES if code != "en"])).alias("source_lang"),
        F.lit("en").alias("target_lang"),
        F.concat(F.lit("[translated] "), F.col("text")).alias("translated"),
    )


def reply_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Known translations of English replies: the assistant turns."""
    return (
        table(spark, folder, "conversations")
        .where(F.col("role") == "assistant")
        .select("text")
        .distinct()
        .select(
            "text",
            F.lit("en").alias("source_lang"),
            F.explode(F.array(*[F.lit(code) for code in LANGUAGES if code != "en"])).alias("target_lang"),
            F.concat(F.lit("[local] "), F.col("text")).alias("translated"),
        )
    )
