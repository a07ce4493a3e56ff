"""Relational operators, upserts and the knowledge base on traps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import history, messages as inbound_ops, metrics, quality, stats, translation, upserts
from talkmill.session import scratch_path
from talkmill.sources import knowledge_base as kbs
from talkmill.sources.tables import append_messages

T0 = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_fan_out_equals_the_join(spark):
    """Message counts of the exact view are those of the two-branch join."""
    generator = random.Random(1)
    users = spark.createDataFrame(
        [(u, "system" if u == 0 else f"+{u}", at(-60 * 24 * u)) for u in range(12)],
        "id long, phone_number string, last_active_at timestamp_ntz",
    )
    convs = spark.createDataFrame([(c, generator.randrange(9)) for c in range(20)], "id long, user_id long")
    msgs = spark.createDataFrame(
        [(m, 3 if m % 3 == 0 else generator.randrange(12), generator.choice(["voice", "text", "system"]), "incoming") for m in range(200)],
        "id long, user_id long, message_type string, direction string",
    )
    found = stats.active_user_stats(users, convs, msgs, F.lit(T0).cast("timestamp_ntz")).first()
    joined = (
        users.where("phone_number != 'system'")
        .join(convs.select(F.col("id").alias("c"), F.col("user_id").alias("id")), "id", "left")
        .join(msgs.select(F.col("id").alias("m"), F.col("user_id").alias("id"), "message_type"), "id", "left")
        .agg(
            F.count("m").alias("m"), F.count_if(F.col("message_type") == "voice").alias("v"),
            F.count_distinct("c").alias("c"), F.count_distinct("id").alias("u"),
        )
        .first()
    )
    assert (found.total_messages, found.voice_messages, found.total_conversations, found.total_users) == (joined.m, joined.v, joined.c, joined.u)
    assert (found.active_last_24h, found.active_last_7d, found.active_last_30d) == (0, 6, 11)


def test_missing_time_is_newest(spark):
    rows = spark.createDataFrame(
        [(1, 5, at(0)), (2, 5, None), (3, 5, at(9)), (4, 5, at(9))], "id long, user_id long, created_at timestamp_ntz"
    )
    newest = history.latest_per_key(rows, "user_id", 3).orderBy("rank").collect()
    assert [row.id for row in newest] == [2, 4, 3]


def test_conversation_without_messages_is_kept(spark):
    convs = spark.createDataFrame([(1, 1, at(0), 0)], "id long, user_id long, started_at timestamp_ntz, message_count int")
    msgs = spark.createDataFrame([], "id long, conversation_id long, content string, created_at timestamp_ntz")
    row = history.last_message(convs, msgs).first()
    assert row.last_message is None and row.conversation_id == 1


def test_unknown_language_is_a_group(spark):
    msgs = spark.createDataFrame([("en",), (None,), (None,)], "language string")
    assert {(r.language, r.messages) for r in stats.language_distribution(msgs).collect()} == {("en", 1), (None, 2)}


def brute_sessions(rows, gap):
    sessions = []
    for user in sorted({user for user, _ in rows}):
        times = sorted(time for who, time in rows if who == user)
        start = last = times[0]
        count = 1
        for time in times[1:]:
            if time - last > gap:
                sessions.append((user, start, last, count))
                start, count = time, 0
            last, count = time, count + 1
        sessions.append((user, start, last, count))
    return sorted(sessions)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_with_a_busy_user(spark, seed):
    generator = random.Random(seed)
    rows = [(1 if i % 3 == 0 else generator.randrange(2, 9), at(generator.randrange(0, 6000)) ) for i in range(600)]
    rows += [(99, at(0)), (99, at(30)), (99, at(61))]
    df = spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz")
    found = upserts.sessionise(df).collect()
    assert sorted((r.user_id, r.started_at, r.last_activity_at, r.messages) for r in found) == brute_sessions(rows, dt.timedelta(minutes=30))
    assert all(r.expires_at - r.last_activity_at == dt.timedelta(minutes=30) for r in found)


def test_patch_ignores_empty_values(spark):
    users = spark.createDataFrame(
        [(1, "Ama", "Ho", "1 acre", ["rice"], at(0)), (2, "Kojo", None, None, None, at(0))],
        "id long, name string, location string, farm_size string, crops array<string>, updated_at timestamp_ntz",
    )
    patches = spark.createDataFrame(
        [(1, "", None, "", []), (2, "Kofi", "Wa", None, ["maize"])],
        "user_id long, name string, location string, farm_size string, crops array<string>",
    )
    found = {r.id: r for r in upserts.patch_profiles(users, patches, F.lit(at(5)).cast("timestamp_ntz")).collect()}
    assert (found[1].name, found[1].crops, found[1].updated_at) == ("Ama", ["rice"], at(0))
    assert (found[2].name, found[2].location, found[2].crops, found[2].updated_at) == ("Kofi", "Wa", ["maize"], at(5))


def test_of_several_patches_the_last_filled_value_wins(spark):
    users = spark.createDataFrame(
        [(1, "Ama", "Ho", "1 acre", ["rice"], at(0))],
        "id long, name string, location string, farm_size string, crops array<string>, updated_at timestamp_ntz",
    )
    patches = spark.createDataFrame(
        [(1, "Zoe", "Wa", None, [], 1), (1, "Abena", "", "2 acres", None, 2)],
        "user_id long, name string, location string, farm_size string, crops array<string>, no int",
    )
    (row,) = upserts.patch_profiles(users, patches, F.lit(at(5)).cast("timestamp_ntz"), "no").collect()
    assert (row.name, row.location, row.farm_size, row.crops, row.updated_at) == ("Abena", "Wa", "2 acres", ["rice"], at(5))


def test_language_changes_are_applied(spark):
    users = spark.createDataFrame(
        [(1, "en", at(0)), (2, "en", at(0)), (3, None, at(0))],
        "id long, preferred_language string, updated_at timestamp_ntz",
    )
    seen = spark.createDataFrame(
        [(1, 1, "tw", at(1)), (2, 1, "ga", at(2)), (3, 2, "en", at(1)), (4, 3, None, at(1)), (5, 3, "ee", at(1))],
        "id long, user_id long, language string, created_at timestamp_ntz",
    )
    rows = upserts.apply_language_changes(users, seen, F.lit(at(9)).cast("timestamp_ntz")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "ga", at(9)), (2, "en", at(0)), (3, "ee", at(9))]


def test_first_name_wins_even_when_missing(spark):
    users = spark.createDataFrame(
        [(1, "+1", "Old", "en", at(0), at(0), at(0))],
        "id long, phone_number string, name string, preferred_language string, created_at timestamp_ntz, updated_at timestamp_ntz, last_active_at timestamp_ntz",
    )
    log = spark.createDataFrame(
        [(1, "+1", "New", "tw", at(1)), (2, "+2", None, "tw", at(2)), (3, "+2", "Late", None, at(3))],
        "event_id long, phone_number string, name string, language string, ts timestamp_ntz",
    )
    merged = upserts.upsert_users(users, log, F.lit(at(9)).cast("timestamp_ntz"))
    found = {r.phone_number: r for r in merged.collect()}
    assert (found["+1"].name, found["+1"].preferred_language, found["+1"].last_active_at) == ("Old", "en", at(1))
    assert (found["+2"].name, found["+2"].preferred_language, found["+2"].created_at) == (None, "tw", at(2))
    event = upserts.user_created_events(merged).first()
    assert event.event_data == '{"phone_number":"+2","name":null}'


def test_newest_active_conversation(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    convs = spark.createDataFrame(
        [(10, 1, at(0), True), (11, 1, at(5), True), (12, 1, at(9), False), (20, 2, at(0), False)],
        "id long, user_id long, started_at timestamp_ntz, is_active boolean",
    )
    found = {r.user_id: (r.conversation_id, r.is_new) for r in upserts.assign_conversation(users, convs, F.lit(-1)).collect()}
    assert found == {1: (11, False), 2: (-1, True), 3: (-1, True)}


def test_cascade(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    convs = spark.createDataFrame([(10, 1), (20, 2)], "id long, user_id long")
    msgs = spark.createDataFrame([(1, 10, 2), (2, 20, 2), (3, 20, 1)], "id long, conversation_id long, user_id long")
    kept = history.cascade_delete(users.where("id = 1"), users, convs, {"messages": msgs})
    assert [r.id for r in kept["users"].collect()] == [2]
    assert [r.id for r in kept["messages"].collect()] == [2]


def test_uploads(spark):
    cases = [
        ("audio/ogg; codecs=opus", 5, "accepted"), (None, 5, "accepted"), ("", 5, "accepted"), ("video/mp4", 5, "unsupported_format"),
        (";audio/ogg", 5, "unsupported_format"), ("audio/wav", 10 * 1024 * 1024, "accepted"), ("audio/wav", 10 * 1024 * 1024 + 1, "too_large"),
    ]
    df = spark.createDataFrame(cases, "content_type string, size_bytes long, expected string")
    assert all(r.verdict == r.expected for r in inbound_ops.validate_uploads(df).collect())


def test_routing(spark):
    cases = [
        ("1@g.us", " hi ", "chat", False), ("status@broadcast", "x", "chat", False), ("2@c.us", None, "ptt", True),
        ("3@c.us", " HELLO ", "chat", False), ("4@c.us", "/help", "ptt", False), ("5@c.us", None, "image", True),
    ]
    df = spark.createDataFrame(cases, "sender string, body string, type string, has_media boolean")
    found = {r.sender: (r.route, r.command) for r in inbound_ops.classify_command(inbound_ops.route_messages(df)).collect()}
    assert found == {
        "2@c.us": ("voice", None), "3@c.us": ("text", "welcome"), "4@c.us": ("text", "help"), "5@c.us": ("text", "question"),
    }


def test_translation(spark):
    memory = spark.createDataFrame(
        [("tw", "akwaaba", "en", "welcome"), ("en", "thanks", "tw", "medaase")], "source_lang string, text string, target_lang string, translated string"
    )
    asked = spark.createDataFrame([("akwaaba", "tw"), ("unknown", "tw"), ("hello", "en"), ("", "tw")], "text string, source_lang string")
    found = {r.text: (r.english, r.translation_confidence, r.source_lang) for r in translation.translate_to_english(asked, memory).collect()}
    assert found == {"akwaaba": ("welcome", 0.8, "tw"), "unknown": ("unknown", 0.0, "tw"), "hello": ("hello", 1.0, "en"), "": ("", 0.0, "en")}
    replies = spark.createDataFrame([("thanks", "tw"), ("thanks", "ga"), ("thanks", "en")], "text string, target_lang string")
    local = translation.translate_from_english(replies, memory)
    assert {r.target_lang: r.reply for r in translation.bilingual(local).collect()} == {
        "tw": "medaase\n\n[English: thanks]", "ga": "thanks", "en": "thanks",
    }
    assert translation.bilingual(local, include_english=False).where("target_lang = 'tw'").first().reply == "medaase"


def test_audit(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), (None, 1)], "k string, parent long")
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    found = quality.audit(
        quality.unique(rows, "t", "k"), quality.row_rules(rows, "t", ["k"], {"k": 0}), quality.references(rows, "t", "parent", parents)
    )
    assert {r.constraint_name: r.violations for r in found.collect()} == {
        "unique(k)": 1, "not_null(k)": 2, "length(k) <= 0": 2, "foreign key(parent)": 1,
    }


def test_active_sliding_counts_each_user_once(spark):
    rows = [(1, at(0)), (1, at(1)), (2, at(90)), (1, at(200))]
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz")
    found = {r.window_start: r.active_users for r in metrics.active_sliding(df, "u", "ts", "2 hours", "1 hour").collect()}
    assert found[at(0)] == 2 and found[at(-60)] == 1 and found[at(60)] == 1


def test_top_questions_with_many_copies(spark):
    texts = ["How?"] * 50 + [" how? "] * 30 + ["Why?"] * 20 + [f"What {i}?" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    exact = [tuple(r) for r in metrics.top_questions(df, "t", 3).collect()]
    assert exact == [("how?", 80), ("why?", 20), ("what 0?", 1)]
    assert [tuple(r) for r in metrics.top_questions_approx(df, "t", 2).collect()] == exact[:2]


# Knowledge base

KB = [("What, then?", 'say "yes"\nor no', "a"), ("what,  THEN? ", "again", "b"), ("ab?cd e?", "", "c"), (" pad ", "x ", "d")]


def test_csv_round_trip_and_append(spark):
    kb = spark.createDataFrame(KB, "question string, answer string, source string")
    path = scratch_path(spark, "test-kb")
    kbs.append_csv(kb, path)
    # an empty field is a missing value
    expected = sorted(tuple(field or None for field in row) for row in KB)
    assert sorted(map(tuple, kbs.read_csv(spark, path).collect())) == expected
    kbs.append_csv(kb, path)
    assert kbs.read_csv(spark, path).count() == 2 * len(KB)
    assert kbs.target_reached(kb, 5).first().reached is False


def test_missing_file_and_columns(spark):
    empty = kbs.read_csv(spark, scratch_path(spark, "absent"))
    assert empty.columns == ["question", "answer", "source"] and empty.count() == 0
    with pytest.raises(ValueError):
        kbs.normalise(spark.createDataFrame([("q",)], "question string"))
    assert kbs.normalise(spark.createDataFrame([("q", "a")], "question string, answer string")).first().source == "csv:knowledge_base"


def test_dedup_damage_and_diff(spark):
    kb = spark.createDataFrame([(i, *row) for i, row in enumerate(KB)], "id long, question string, answer string, source string")
    assert sorted(r.id for r in kbs.dedup(kb).collect()) == [0, 2, 3]
    assert [(r.id, r.damaged_places) for r in kbs.damaged(kb).collect()] == [(2, 1)]
    newer = kb.where("id > 0").unionByName(kb.where("id = 3"))
    assert {(r.change, r.question, r.copies) for r in kbs.snapshot_diff(kb, newer).collect()} == {
        ("removed", "What, then?", 1), ("added", " pad ", 1),
    }


def test_snapshots_stay_apart(spark):
    kb = spark.createDataFrame(KB, "question string, answer string, source string")
    path = scratch_path(spark, "test-snapshots")
    kbs.write_snapshot(kb, path, "20240101_000000")
    kbs.write_snapshot(kb.limit(1), path, "20240102_000000")
    assert kbs.read_snapshot(spark, path, "20240101_000000").count() == len(KB)
    assert kbs.read_snapshot(spark, path, "20240102_000000").count() == 1


def test_row_numbers_over_partitions(spark):
    ids = list(range(0, 3000, 3))
    random.Random(4).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    found = {r.id: r.row_number for r in kbs.numbered(df, "id").collect()}
    assert found == {i: n for n, i in enumerate(sorted(ids), start=1)}


def test_message_sink_fills_defaults(spark):
    path = scratch_path(spark, "test-messages")
    append_messages(spark.createDataFrame([(1, "hi")], "id long, content string"), path)
    row = spark.read.parquet(path).first()
    assert (row.message_type, row.language, row.metadata) == ("text", "en", "{}")


def test_csv_export(spark):
    path = scratch_path(spark, "test-export")
    metrics.export_csv(spark.createDataFrame([("en", 2)], "language string, messages long"), path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("en", "2")]


def test_audit_scans_every_table_once(spark, data):
    from talkmill.plans.catalog import QUERIES

    plan = QUERIES["constraint_audit"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # sessions, preferences, analytics, users, signups, messages, conversations and the log, each one branch of the union
    assert plan.count("Generate inline(") == 8 and plan.count("Union") == 1


def test_audit_counts_hot_keys_and_pairs_of_columns(spark):
    rows = spark.createDataFrame([(1, "a", 5)] * 1000 + [(1, "b", None), (None, "b", 6)], "k long, name string, parent long")
    parents = spark.createDataFrame([(5,), (5,), (None,)], "id int")
    found = quality.audit(
        quality.unique(rows, "t", "k", "name"), quality.references(rows, "t", "parent", parents), quality.row_rules(rows, "t", ["k"], {"name": 1})
    )
    assert sorted(tuple(r) for r in found.collect()) == [
        ("t", "foreign key(parent)", 1), ("t", "length(name) <= 1", 0), ("t", "not_null(k)", 1), ("t", "unique(k, name)", 999)
    ]
