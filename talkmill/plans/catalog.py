"""The named queries: every operator over the whole base tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import codes, errors, jsonlog, text
from talkmill.functions.language import detect_language, detect_language_simple, detection_method
from talkmill.functions.transcript import parse_transcript
from talkmill.operators import (
    history, messages as inbound_ops, metrics, quality, rerank, retrieval, stats, tfidf, translation, upserts, vectors,
)
from talkmill.plans import sql_surface
from talkmill.plans.question_flow import answer_prompts
from talkmill.schemas import MAX_LENGTHS
from talkmill.session import scratch_path
from talkmill.sources import knowledge_base, views
from talkmill.sources.tables import append_messages as append_rows, spread, table
from talkmill.streaming import jobs, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K_CHUNKS, K_VECTORS = 8, 5


def query(function: Query) -> Query:
    """Register a query under its function's name, leading underscore aside."""
    QUERIES[function.__name__.lstrip("_")] = function
    return function


def _as_of(spark: SparkSession, folder: str) -> Column:
    """The newest event stands for the current time."""
    return table(spark, folder, "events").agg(F.max("ts")).scalar()


_models: dict[tuple[str, str], tfidf.TfidfModel] = {}


def keyword_model(spark: SparkSession, folder: str) -> tfidf.TfidfModel:
    """The model of a folder's knowledge base, fitted once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _models:
        _models[key] = tfidf.fit(views.kb(spark, folder))
    return _models[key]


# Knowledge base

@query
def kb_scan_csv(spark, folder):
    path = scratch_path(spark, "kb-csv")
    knowledge_base.append_csv(views.kb(spark, folder), path)
    return knowledge_base.read_csv(spark, path)


@query
def kb_normalize(spark, folder):
    return knowledge_base.normalise(views.kb(spark, folder).drop("source"))


@query
def kb_append(spark, folder):
    """Documents first, then the answered user turns of the conversations."""
    path = scratch_path(spark, "kb-append")
    turns = views.message_text(spark, folder)
    answers = turns.where(F.col("direction") == "outgoing").select(
        "conversation_id", (F.col("seq") - 1).alias("seq"), F.col("content").alias("answer")
    )
    pairs = turns.where(F.col("direction") == "incoming").join(answers, ["conversation_id", "seq"]).select(
        F.col("content").alias("question"), "answer", F.lit("conversation").alias("source")
    )
    knowledge_base.append_csv(views.kb(spark, folder), path)
    knowledge_base.append_csv(pairs, path)
    kb = knowledge_base.read_csv(spark, path)
    return kb.groupBy("source").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.length("question")).alias("question_chars"),
        F.sum(F.length("answer")).alias("answer_chars"),
    )


@query
def kb_missing_file(spark, folder):
    """Entries per source of two collections, one of which is not there."""
    path = scratch_path(spark, "kb-there")
    knowledge_base.append_csv(views.kb(spark, folder), path)
    both = knowledge_base.read_csv(spark, path).unionByName(knowledge_base.read_csv(spark, f"{path}-missing"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("entries"))


@query
def kb_snapshot(spark, folder):
    """Two snapshots side by side, and the entries of the one asked for."""
    path, kb = scratch_path(spark, "kb-snapshots"), views.kb(spark, folder)
    knowledge_base.write_snapshot(kb, path, "20240101_000000")
    knowledge_base.write_snapshot(kb.where(F.col("id") % 2 == 0), path, "20240102_000000")
    return knowledge_base.read_snapshot(spark, path, "20240101_000000").select("id", "question", "source")


@query
def append_messages(spark, folder):
    """The message sink: rows written twice without the columns it fills in."""
    path, log = scratch_path(spark, "messages"), views.messages(spark, folder)
    bare = log.select("id", "user_id", "conversation_id", "direction", "content", "created_at")
    append_rows(bare, path)
    append_rows(bare.withColumn("language", F.lit("tw")), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("message_type", "language", "metadata").agg(F.count(F.lit(1)).alias("messages"))


@query
def export_summary(spark, folder):
    """A summary written as CSV and read back."""
    path = scratch_path(spark, "summary")
    metrics.export_csv(stats.event_counts(views.analytics(spark, folder)), path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@query
def kb_batches(spark, folder):
    return knowledge_base.append_batches(views.kb(spark, folder))


@query
def kb_target(spark, folder):
    return knowledge_base.target_reached(views.kb(spark, folder))


@query
def kb_dedup(spark, folder):
    return knowledge_base.dedup(views.kb(spark, folder)).select("id", "question", "source")


@query
def kb_damaged(spark, folder):
    """Run on the collection as it looks after a conversion to ASCII with '?'."""
    lossy = views.kb(spark, folder).withColumn("question", F.regexp_replace("question", r"[^\x00-\x7F]", "?"))
    return knowledge_base.damaged(lossy).select("id", "question", "damaged_places")


@query
def kb_snapshot_diff(spark, folder):
    """Older: all documents. Newer: without the toxic ones, plus the benchmark passages."""
    kb = views.kb(spark, folder)
    toxic = table(spark, folder, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    newer = kb.join(toxic, "id", "left_anti").select("question").unionByName(
        views.questions(spark, folder).select(F.col("query").alias("question"))
    )
    return knowledge_base.snapshot_diff(kb, newer)


# Users, conversations and messages

@query
def users_page(spark, folder):
    page = history.users_page(views.users(spark, folder), limit=10, offset=20)
    return history.user_dicts(page)


@query
def user_by_phone(spark, folder):
    return history.user_dicts(history.user_by_phone(views.users(spark, folder), "+000000042"))


@query
def message_dicts(spark, folder):
    return history.message_dicts(views.messages(spark, folder))


@query
def conversation_dicts(spark, folder):
    return history.conversation_dicts(views.conversations(spark, folder))


@query
def history_one(spark, folder):
    user = history.user_by_phone(views.users(spark, folder), "+000000042")
    return history.history_of(views.messages(spark, folder), user, limit=20)


@query
def history_all(spark, folder):
    return history.latest_per_key(views.messages(spark, folder), "user_id", limit=10)


@query
def last_message(spark, folder):
    return history.last_message(views.conversations(spark, folder), views.messages(spark, folder))


@query
def recent_conversations(spark, folder):
    return history.recent_conversations(views.conversations(spark, folder), views.messages(spark, folder), limit=10)


def _sessions(spark, folder):
    """Session rows with key, token, conversation and whether they are still open."""
    found = upserts.sessionise(views.messages(spark, folder)).withColumn("_now", _as_of(spark, folder))
    return found.select(
        (F.col("user_id") * 100000 + F.col("session_no")).alias("id"),
        "user_id",
        (F.col("user_id") * 1000 + F.floor((F.dayofmonth("started_at") - 1) / 10)).alias("conversation_id"),
        F.concat_ws("-", "user_id", "session_no").alias("session_token"),
        "started_at", "last_activity_at", "expires_at",
        (F.col("expires_at") >= F.col("_now")).alias("is_active"),
    )


@query
def session_dicts(spark, folder):
    return history.session_dicts(_sessions(spark, folder))


@query
def analytics_dicts(spark, folder):
    return history.analytics_dicts(views.analytics(spark, folder))


@query
def user_nested(spark, folder):
    log = views.messages(spark, folder)
    return history.user_overview(
        views.users(spark, folder), views.conversations(spark, folder), log,
        upserts.sessionise(log), views.preferences(spark, folder),
    )


@query
def cascade_delete(spark, folder):
    """Delete the users of one location; rows left per table."""
    users, log = views.users(spark, folder), views.messages(spark, folder)
    kept = history.cascade_delete(
        users.where(F.col("location") == "FRANCE").select("id"), users, views.conversations(spark, folder),
        {
            "messages": log, "sessions": _sessions(spark, folder), "analytics": views.analytics(spark, folder),
            "preferences": views.preferences(spark, folder),
        },
    )
    counts = [
        rows.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        for name, rows in kept.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def insert_if_absent(spark, folder):
    existing = views.users(spark, folder).select("phone_number", "name", "preferred_language")
    return history.insert_if_absent(existing, views.signups(spark, folder), "phone_number", "id").select(
        "phone_number", "name", "preferred_language"
    )


# Statistics

@query
def user_stats(spark, folder):
    return stats.user_stats(*(view(spark, folder) for view in (views.users, views.conversations, views.messages)))


@query
def overall_stats(spark, folder):
    return stats.overall_stats(*(view(spark, folder) for view in (views.users, views.conversations, views.messages)))


@query
def active_user_stats(spark, folder):
    model = (view(spark, folder) for view in (views.users, views.conversations, views.messages))
    return stats.active_user_stats(*model, as_of=_as_of(spark, folder))


@query
def active_user_stats_true(spark, folder):
    model = (view(spark, folder) for view in (views.users, views.conversations, views.messages))
    return stats.active_user_stats(*model, as_of=_as_of(spark, folder), fan_out=False)


@query
def language_dist(spark, folder):
    return stats.language_distribution(views.messages(spark, folder))


@query
def type_direction(spark, folder):
    return stats.type_direction_counts(views.messages(spark, folder))


@query
def conv_message_count(spark, folder):
    return stats.messages_per_conversation(views.messages(spark, folder))


@query
def conv_count_drift(spark, folder):
    return stats.counter_drift(views.conversations(spark, folder), views.messages(spark, folder))


@query
def event_counts(spark, folder):
    return stats.event_counts(views.analytics(spark, folder))


@query
def messages_per_period(spark, folder):
    return metrics.messages_per_period(views.messages(spark, folder))


@query
def top_questions(spark, folder):
    return metrics.top_questions(_documents(spark, folder), "text", limit=20)


@query
def latency_stats(spark, folder):
    return metrics.latency_stats(views.timings(spark, folder))


@query
def popular_terms(spark, folder):
    dictionary = metrics.vocabulary(views.questions(spark, folder), "query")
    return metrics.popular_terms(views.message_text(spark, folder), "content", dictionary)


@query
def popular_crops(spark, folder):
    return metrics.crop_counts(views.users(spark, folder))


@query
def activity_5min(spark, folder):
    return metrics.activity(views.messages(spark, folder), "user_id", "created_at")


@query
def active_sliding(spark, folder):
    return metrics.active_sliding(views.messages(spark, folder), "user_id", "created_at")


@query
def active_sliding_all(spark, folder):
    """Active users per hour for the three widths of the statistics view, in one pass."""
    widths = {"24 hours": 24, "7 days": 7 * 24, "30 days": 30 * 24}
    return metrics.active_sliding_widths(views.messages(spark, folder), "user_id", "created_at", widths)


# The same from SQL

_SQL_PREFIX = "model_"


def _sql(spark, folder, statement):
    """A statement over the registered model; stored vectors belong to the messages of their numbers."""
    stored = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    sql_surface.register(
        spark, views.users(spark, folder), views.conversations(spark, folder),
        views.messages(spark, folder).join(stored, "id", "left"), _as_of(spark, folder), _SQL_PREFIX,
    )
    return spark.sql(statement.format(p=_SQL_PREFIX))


@query
def sql_active_user_stats(spark, folder):
    return _sql(spark, folder, "SELECT * FROM {p}active_user_stats")


@query
def sql_recent_conversations(spark, folder):
    """One user's conversations."""
    return _sql(spark, folder, "SELECT * FROM {p}get_user_recent_conversations(42, 2)")


@query
def sql_recent_of_all(spark, folder):
    """The newest conversations of every user, users without any included."""
    return _sql(
        spark, folder,
        "SELECT u.id AS user_id, r.* FROM {p}users u LEFT JOIN LATERAL {p}get_user_recent_conversations(u.id, 2) r",
    )


@query
def sql_similar_messages(spark, folder):
    """The messages nearest to the vector of message 7, over all users and over user 42's."""
    vector = table(spark, folder, "embeddings").where("vec_id = 7").first().embedding
    values = ", ".join(repr(float(x)) + "D" for x in vector)
    search = "SELECT '{0}' AS scope, * FROM {{p}}search_similar_messages(array({2}), {1}, 6)"
    return _sql(spark, folder, " UNION ALL ".join(
        search.format(scope, user, values) for scope, user in (("all", "NULL"), ("one user", "42"))
    ))


# Inbound messages

def _routed(spark, folder):
    return inbound_ops.route_messages(views.inbound(table(spark, folder, "events")))


def _answered(routed: DataFrame) -> DataFrame:
    """Routed messages with the response they got; greetings and help requests get none of the advisor's."""
    asked = F.col("command").isNull() | (F.col("command") == "question")
    return inbound_ops.classify_command(routed).withColumn(
        "response", F.when(asked, F.concat(F.lit("Re: "), F.coalesce("body", F.lit(""))))
    )


@query
def route_messages(spark, folder):
    return _routed(spark, folder).select("event_id", "sender", "type", "has_media", "route")


@query
def classify_command(spark, folder):
    return inbound_ops.classify_command(_routed(spark, folder)).select("event_id", "body", "route", "command")


@query
def validate_upload(spark, folder):
    return inbound_ops.validate_uploads(views.uploads(spark, folder))


@query
def normalize_sender(spark, folder):
    rows = views.inbound(table(spark, folder, "events"))
    return rows.select(
        "event_id",
        text.normalise_sender(F.col("sender")).alias("phone_number"),
        text.display_name(F.col("push_name"), F.col("contact_name"), F.col("sender")).alias("display_name"),
    )


@query
def error_categories(spark, folder):
    rows = views.failures(spark, folder)
    category = errors.error_category(F.col("channel"), F.col("code"), F.col("message"))
    return (
        rows.groupBy("channel", category.alias("category")).agg(F.count(F.lit(1)).alias("failures"))
        .withColumn("shown_text", errors.error_text(F.col("channel"), F.col("category")))
    )


@query
def message_previews(spark, folder):
    rows = views.message_text(spark, folder)
    return rows.select(
        "conversation_id", "seq",
        text.preview(F.col("content"), 50).alias("short_preview"),
        text.preview_with_ellipsis(F.col("content"), 100).alias("long_preview"),
        text.kilobytes(F.octet_length("content")).alias("size_kb"),
    )


@query
def request_times(spark, folder):
    """ISO text of every event's time and the milliseconds to the end of its day."""
    rows = table(spark, folder, "events")
    midnight = F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz")
    return rows.select(
        "event_id", text.iso_utc(F.col("ts")).alias("iso_time"), text.elapsed_ms(F.col("ts"), midnight).alias("ms_left")
    )


# Language and text

def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query
def tokens(spark, folder):
    return _documents(spark, folder).select(
        F.col("doc_id").alias("id"), F.array_join(text.tokens(F.col("text")), " ").alias("tokens")
    )


@query
def _detect_language(spark, folder):
    found = detect_language(views.transliterated(_documents(spark, folder)), "text")
    return found.select(
        "id", "language", F.round("confidence", 6).alias("confidence"), detection_method(F.col("confidence")).alias("method")
    )



@query
def _detect_language_simple(spark, folder):
    documents = _documents(spark, folder).withColumnRenamed("doc_id", "id")
    return detect_language_simple(documents, "text").select("id", "language")



@query
def _parse_transcript(spark, folder):
    return parse_transcript(views.asr_replies(_documents(spark, folder))).select("id", "text", "language", "error")



@query
def language_codes(spark, folder):
    """Documents per declared language code with every code lookup."""
    per_code = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).unionByName(
        views.messages(spark, folder).groupBy(F.col("language").alias("lang")).agg(F.count(F.lit(1)).alias("documents"))
    )
    code = F.col("lang")
    return per_code.select(
        "lang", "documents",
        codes.from_external(code).alias("own_code"),
        codes.to_external(code).alias("external_code"),
        codes.language_name(code).alias("language_name"),
        codes.is_supported(code).alias("supported"),
    )


@query
def translate_lookup(spark, folder):
    asked = detect_language(views.questions(spark, folder), "query", "source_lang")
    return translation.translate_to_english(
        asked.select("query_id", F.col("query").alias("text"), "source_lang"), views.translation_memory(spark, folder)
    ).select("query_id", "source_lang", "english", "translation_confidence")


@query
def bilingual_text(spark, folder):
    """Every turn as a reply in the language of its conversation's turn."""
    turns = views.message_text(spark, folder).select(
        "conversation_id", "seq", F.col("content").alias("text"),
        views.nth(("en", "tw", "ga", "ee", "dag"), (F.col("conversation_id") + F.col("seq")) % 5).alias("target_lang"),
    )
    local = translation.translate_from_english(turns, views.reply_translations(spark, folder))
    return translation.bilingual(local).select("conversation_id", "seq", "target_lang", "translated_ok", "reply")


@query
def parse_logs(spark, folder):
    return jsonlog.parse_logs(views.log_lines(spark, folder)).drop("line")


@query
def write_logs(spark, folder):
    """Log lines written from columns, absent fields left out."""
    parsed = jsonlog.parse_logs(views.log_lines(spark, folder)).where(~F.col("malformed"))
    fields = ["timestamp", "level", "logger", "message", "exception", "request_id", "duration_ms"]
    return parsed.select("line_no", jsonlog.format_log(*fields).alias("json"))


@query
def event_payload(spark, folder):
    return views.analytics(spark, folder).select(
        "id", "event_type", jsonlog.payload_value(F.col("event_data"), "$.k").cast("long").alias("k")
    )


# Retrieval

@query
def tfidf_weights(spark, folder):
    return keyword_model(spark, folder).weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _keyword(spark, folder, filled=False, k=K_CHUNKS):
    model, asked, kb = keyword_model(spark, folder), views.questions(spark, folder), views.kb(spark, folder)
    return tfidf.search_filled(model, asked, kb, k) if filled else tfidf.search(model, asked, k)


def _with_chunks(spark, folder, results):
    return tfidf.with_chunks(results, views.kb(spark, folder), K_CHUNKS * views.questions(spark, folder).count())


@query
def tfidf_topk(spark, folder):
    return _with_chunks(spark, folder, _keyword(spark, folder)).select(
        "query_id", "rank", "doc_id", "score", "chunk", "source"
    )


@query
def tfidf_topk_filled(spark, folder):
    return _keyword(spark, folder, filled=True).select("query_id", "rank", "doc_id", "score")


def _semantic(spark, folder, k=K_VECTORS, by_user=False):
    return vectors.vector_topk(views.vectors(spark, folder), views.question_vectors(spark, folder), k, by_user)


def _with_similarity(results):
    return results.select(
        "query_id", "rank", "id", "distance", F.round(F.lit(1.0) - F.col("distance"), 6).alias("similarity")
    )


@query
def vector_topk(spark, folder):
    return _with_similarity(_semantic(spark, folder))


@query
def vector_topk_filtered(spark, folder):
    return _with_similarity(_semantic(spark, folder, by_user=True))


@query
def similar_messages(spark, folder):
    """The nearest stored texts of every question with their content."""
    contents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = views.question_vectors(spark, folder)
    found = _with_similarity(_semantic(spark, folder))
    return vectors.with_content(found, contents, K_VECTORS * asked.count()).select(
        "query_id", "rank", "id", "content", "similarity"
    )


_indexes: dict[tuple[str, str], vectors.InvertedLists] = {}


def vector_index(spark: SparkSession, folder: str) -> vectors.InvertedLists:
    """The index of a folder's vectors, built once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        _indexes[key] = vectors.InvertedLists(views.vectors(spark, folder))
    return _indexes[key]


def _indexed(spark, folder):
    return vector_index(spark, folder).search(views.question_vectors(spark, folder), K_VECTORS)


@query
def vector_ivf(spark, folder):
    return _with_similarity(_indexed(spark, folder))


@query
def vector_ivf_recall(spark, folder):
    """Rows per question of the search of ``vector_ivf``, and whether four of five are the nearest; it is exact, so all are."""
    found = _indexed(spark, folder).select("query_id", "id")
    exact = _semantic(spark, folder).select("query_id", "id", F.lit(True).alias("_near"))
    share = F.count("_near") / F.count(F.lit(1))
    return found.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("rows"), (share >= 0.8).alias("good")
    )


@query
def vector_ivf_all_lists(spark, folder):
    """All lists probed: must equal the exact search."""
    lists = vectors.InvertedLists(views.vectors(spark, folder), lists=8)
    return _with_similarity(lists.search(views.question_vectors(spark, folder), K_VECTORS, probes=8))


def _fused(spark, folder, k):
    semantic = _semantic(spark, folder, k=k).withColumnRenamed("id", "doc_id")
    return retrieval.reciprocal_rank_fusion(_keyword(spark, folder, k=k), semantic, k)


@query
def hybrid_rrf(spark, folder):
    return _fused(spark, folder, K_CHUNKS).select(
        "query_id", "rank", "doc_id", "keyword_rank", "semantic_rank", "score"
    )


@query
def hybrid_rerank(spark, folder):
    """The chunks of every question, chosen from three times as many fused candidates."""
    return rerank.rerank(
        _fused(spark, folder, 3 * K_CHUNKS), views.questions(spark, folder), views.kb(spark, folder), K_CHUNKS, 3 * K_CHUNKS
    )


@query
def precision_at_k(spark, folder):
    labels = views.vectors(spark, folder).select("id", F.col("user_id").alias("label"))
    results = _semantic(spark, folder).join(labels, "id").select("query_id", "label")
    truth = views.question_vectors(spark, folder).select("query_id", F.col("user_id").alias("wanted"))
    return retrieval.precision_at_k(results, truth, K_VECTORS)


@query
def overlap_at_k(spark, folder):
    semantic = _semantic(spark, folder, k=K_CHUNKS).withColumnRenamed("id", "doc_id")
    return retrieval.overlap_at_k(_keyword(spark, folder), semantic, K_CHUNKS)


@query
def context_text(spark, folder):
    return retrieval.context_text(_with_chunks(spark, folder, _keyword(spark, folder)))


@query
def prompt_table(spark, folder):
    return answer_prompts(
        views.questions(spark, folder), views.translation_memory(spark, folder), keyword_model(spark, folder),
        views.kb(spark, folder), K_CHUNKS,
    )


# Upserts, derived state and quality

@query
def users_from_log(spark, folder):
    return upserts.upsert_users(views.users(spark, folder), views.message_log(spark, folder), _as_of(spark, folder))


@query
def user_created_events(spark, folder):
    return upserts.user_created_events(users_from_log(spark, folder))


@query
def assign_conversation(spark, folder):
    users = views.users(spark, folder)
    return upserts.assign_conversation(users, views.conversations(spark, folder), new_id=F.col("user_id") * 1000 + 999)


@query
def sessions_gap(spark, folder):
    return upserts.sessionise(views.messages(spark, folder))


@query
def language_changes(spark, folder):
    return upserts.language_changes(views.users(spark, folder), views.messages(spark, folder))


@query
def counters_after_save(spark, folder):
    """Stored counters after every second message was saved once more."""
    log = views.messages(spark, folder)
    counted = upserts.count_saved_messages(views.conversations(spark, folder), log.where(F.col("id") % 2 == 0))
    return counted.select("id", "user_id", "message_count")


@query
def users_after_language(spark, folder):
    changed = upserts.apply_language_changes(
        views.users(spark, folder), views.messages(spark, folder), _as_of(spark, folder)
    )
    return changed.select("id", "preferred_language", "updated_at")


@query
def profile_patch(spark, folder):
    patched = upserts.patch_profiles(
        views.users(spark, folder), views.profile_patches(spark, folder), _as_of(spark, folder)
    )
    return patched.select(
        "id", "name", "location", "farm_size", F.array_join("crops", ",").alias("crops"), "updated_at"
    )


@query
def latest_state(spark, folder):
    return upserts.latest_state(_answered(_routed(spark, folder)))


@query
def constraint_audit(spark, folder):
    users, log = views.users(spark, folder), views.message_log(spark, folder)
    messages, conversations = views.messages(spark, folder), views.conversations(spark, folder)
    sessions, preferences = _sessions(spark, folder), views.preferences(spark, folder)
    analytics = views.analytics(spark, folder)
    return quality.audit(
        quality.unique(sessions, "sessions", "session_token"),
        quality.unique(preferences, "preferences", "user_id"),
        quality.row_rules(sessions, "sessions", [], MAX_LENGTHS["sessions"]),
        quality.row_rules(analytics, "analytics", ["event_type"], MAX_LENGTHS["analytics"]),
        quality.references(sessions, "sessions", "user_id", users),
        quality.references(sessions, "sessions", "conversation_id", conversations),
        quality.references(preferences, "preferences", "user_id", users),
        quality.references(analytics, "analytics", "user_id", users),
        quality.unique(users, "users", "phone_number"),
        quality.unique(views.signups(spark, folder), "signups", "phone_number"),
        quality.row_rules(users, "users", ["phone_number", "created_at"], MAX_LENGTHS["users"]),
        quality.row_rules(
            messages, "messages", ["message_type", "direction", "content", "language"], MAX_LENGTHS["messages"]
        ),
        quality.references(messages, "messages", "user_id", users),
        quality.references(messages, "messages", "conversation_id", conversations),
        quality.references(log, "message_log", "phone_number", users, "phone_number"),
    )


# Streams

@query
def stream_ingest(spark, folder):
    return runner.result_of(spark, jobs.ingest(runner.events_stream(spark, folder)), "ingest")


@query
def stream_activity(spark, folder):
    return runner.result_of(spark, jobs.activity(runner.events_stream(spark, folder)), "activity")


@query
def stream_sessions(spark, folder):
    return runner.result_of(spark, jobs.sessions(runner.events_stream(spark, folder)), "sessions")


@query
def stream_active_sliding(spark, folder):
    return runner.result_of(spark, jobs.active_sliding(runner.events_stream(spark, folder)), "sliding")


@query
def stream_dedup(spark, folder):
    """The event stream delivered twice; each event must come out once."""
    events = runner.events_stream(spark, folder)
    once = jobs.without_repeats(events.unionByName(events))
    return runner.result_of(spark, once.select("event_id", "user_id", "event_type"), "dedup")


def _answered_stream(spark, folder):
    return _answered(inbound_ops.route_messages(views.inbound(runner.events_stream(spark, folder))))


@query
def stream_latest_state(spark, folder):
    return jobs.latest_state(spark, _answered_stream(spark, folder), scratch_path(spark, "latest"))


@query
def stream_expired_senders(spark, folder):
    """Senders that a timer has let go at the end of the stream."""
    return jobs.expired_senders(spark, _answered_stream(spark, folder), scratch_path(spark, "expired"))
