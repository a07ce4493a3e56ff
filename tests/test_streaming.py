"""Streams over growing folders: late rows, repeats and restarts."""

import datetime as dt
import os

from compare import database, difference
from oracles.sql import ORACLES
from pyspark.sql import functions as F

from talkmill.operators.messages import route_messages
from talkmill.session import scratch_path
from talkmill.sources.views import inbound
from talkmill.streaming import jobs, runner, state

T0 = dt.datetime(2024, 5, 1, 12)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, path, *events):
    """One file of (event_id, minute, user_id) events."""
    rows = [(i, T0 + dt.timedelta(minutes=m), u, "click", 1.0, "{}") for i, m, u in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return (
        runner.stream_session(spark)
        .readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(path)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    path = scratch_path(spark, "test-late")
    write(spark, path, (1, 0, 1), (2, 1, 2), (3, 2, 1))
    write(spark, path, (4, 60, 1))
    write(spark, path, (6, 61, 2))  # closes the first window
    write(spark, path, (5, 3, 3), (7, 62, 2))  # minute 3 is too late by now
    found = runner.result_of(spark, jobs.activity(stream(spark, path)), "test-activity").collect()
    assert [(r.window_start, r.messages, r.active_senders) for r in found] == [(T0, 3, 2)]


def test_restart_goes_on_where_it_stopped(spark):
    path, out = scratch_path(spark, "test-restart"), scratch_path(spark, "test-restart-out")
    write(spark, path, (1, 0, 1), (2, 1, 2))
    runner.append_available(jobs.ingest(stream(spark, path)), out)
    write(spark, path, (3, 2, 1))
    runner.append_available(jobs.ingest(stream(spark, path)), out)
    runner.append_available(jobs.ingest(stream(spark, path)), out)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 2]  # 3 is a group message


def test_repeats_come_once(spark):
    path = scratch_path(spark, "test-repeats")
    write(spark, path, (1, 0, 1), (2, 1, 1))
    write(spark, path, (2, 1, 1), (7, 2, 1))
    once = jobs.without_repeats(stream(spark, path)).select("event_id")
    assert sorted(r.event_id for r in runner.result_of(spark, once, "test-once").collect()) == [1, 2, 7]


def test_sessions_close_after_the_gap(spark):
    path = scratch_path(spark, "test-sessions")
    write(spark, path, (1, 0, 1), (2, 20, 1), (4, 45, 1))
    write(spark, path, (8, 200, 2))
    found = runner.result_of(spark, jobs.sessions(stream(spark, path)), "test-sessions-out").collect()
    assert [(r.user_id, r.messages, r.last_activity_at) for r in found] == [(1, 3, T0 + dt.timedelta(minutes=45))]


def test_latest_state_and_expiry(spark):
    path = scratch_path(spark, "test-latest")
    write(spark, path, (1, 0, 1), (2, 5, 2))
    write(spark, path, (4, 60 * 30, 2), (8, 60 * 30 + 1, 2))
    answered = lambda: route_messages(inbound(stream(spark, path))).withColumn("response", F.lit("ok"))
    out = scratch_path(spark, "test-state")
    state = jobs.latest_state(spark, answered(), out)
    found = {r.sender: (r.last_at, r.expired) for r in state.collect()}
    assert found == {
        "000000001@c.us": (T0, True), "000000002@c.us": (T0 + dt.timedelta(minutes=60 * 30 + 1), False),
    }
    for batch in range(4):
        write(spark, path, (16 + batch, 60 * 40 + batch, 1))
        state = jobs.latest_state(spark, answered(), out)
    found = {r.sender: r.last_at for r in state.collect()}
    assert found["000000001@c.us"] == T0 + dt.timedelta(minutes=60 * 40 + 3) and len(found) == 2
    # one snapshot is read, and no more than the one before it and a repeat are kept
    assert len([name for name in os.listdir(out.removeprefix("file://") + "/rows") if "batch=" in name]) <= 3


def test_expiry_is_emitted_by_a_timer_and_forgotten_by_a_newer_message(spark):
    path, out = scratch_path(spark, "test-timer"), scratch_path(spark, "test-timer-out")
    answered = lambda: route_messages(inbound(stream(spark, path))).withColumn("response", F.lit("ok"))
    day = 24 * 60
    write(spark, path, (1, 0, 1), (2, 5, 2), (4, 6, 1))
    gone = lambda: {(r.sender, r.last_at) for r in jobs.expired_senders(spark, answered(), out).collect()}
    assert gone() == set()
    write(spark, path, (8, day + 5, 3))  # the watermark stands ten minutes before that
    assert gone() == set()
    write(spark, path, (9, day + 20, 3))
    assert gone() == {("000000001@c.us", T0 + dt.timedelta(minutes=6)), ("000000002@c.us", T0 + dt.timedelta(minutes=5))}
    write(spark, path, (10, day + 30, 2))
    assert {sender for sender, _ in gone()} == {"000000001@c.us"}
    found = {r.sender: (r.last_at, r.expired) for r in jobs.latest_state(spark, answered(), out).collect()}
    assert found["000000002@c.us"] == (T0 + dt.timedelta(minutes=day + 30), False) and len(found) == 3


def test_bytes_written_follow_the_changed_senders(spark):
    path, out = scratch_path(spark, "test-bytes"), scratch_path(spark, "test-bytes-out")
    answered = lambda: route_messages(inbound(stream(spark, path))).withColumn("response", F.lit("ok"))
    write(spark, path, *[(16 * u + 1, u % 50, u) for u in range(1, 6000)])
    table = jobs.follow_state(spark, answered(), out)
    before = set(table._numbers("rows"))
    assert before and table._bytes("rows", [max(before)]) > 50_000
    write(spark, path, (10**6, 55, 77), (10**6 + 1, 56, 77))
    table = jobs.follow_state(spark, answered(), out)
    # one sender changed: its change is written, the snapshot is not
    assert set(table._numbers("rows")) == before
    later = [n for n in table._numbers("changes") if n > max(before)]
    assert table._read("changes", later).count() == 1 and table._bytes("changes", later) < 12_000 * len(later)
    found = {r.sender: r.event_id for r in table.read().collect()}
    assert found["000000077@c.us"] == 10**6 + 1 and len(found) == table.read().count() > 3000
    # a batch written again replaces itself
    again = [tuple(r) for r in table._read("changes", later).collect()]
    table.add(spark.createDataFrame(again, state.CHANGE), later[-1])
    assert table.read().count() == len(found)


def test_busy_sender_is_cut_before_the_shuffle(spark):
    rows = [("a", "x", "r", "text", 5, 1), ("a", "y", "r", "text", 5, 2), ("b", "z", "r", "text", 1, 3), ("a", "w", "r", "text", 4, 9)]
    frame = spark.createDataFrame(rows, "sender string, body string, response string, route string, us long, event_id long").coalesce(1)
    newest = frame.mapInArrow(state._newest_of_batch, frame.schema)
    assert sorted((r.sender, r.body) for r in newest.collect()) == [("a", "y"), ("b", "z")]


def test_refused_uploads_are_not_stored(spark):
    path = scratch_path(spark, "test-uploads")
    # 4 and 6 are audio of a known type, 11 is not; 9 is just small enough, 27 too large; 25 no voice message
    write(spark, path, *[(i, i, 1) for i in (4, 6, 9, 11, 25, 27)])
    stored = {r.id: r.message_type for r in runner.result_of(spark, jobs.ingest(stream(spark, path)), "uploads").collect()}
    declared = {r.event_id: (r.content_type, r.size_bytes) for r in inbound(spark.read.schema(SCHEMA).parquet(path)).collect()}
    assert declared[11][0] == "video/mp4" and declared[9][1] == 10485760 and declared[27][1] == 10485761
    assert 4 in stored and 9 in stored and 11 not in stored and 27 not in stored


def test_uploads_of_unknown_size_are_stored_by_code_and_sql(spark):
    folder = scratch_path(spark, "test-unknown-size")
    # voice messages without a value have no size; 11 is refused for its type, 27 for its size
    rows = [(i, T0 + dt.timedelta(minutes=i), 1, "click", None, "{}") for i in (1, 2, 4, 6, 8, 9, 11, 12, 27)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/rows")
    part = next(name for name in os.listdir(f"{folder}/rows") if name.endswith(".parquet"))
    os.link(f"{folder}/rows/{part}", f"{folder}/events.parquet")
    found = runner.result_of(spark, jobs.ingest(runner.events_stream(spark, folder)), "unknown-size")
    assert {4, 6, 8, 9} <= {r.id for r in found.where("message_type = 'voice'").collect()}
    assert {11, 27}.isdisjoint(r.id for r in found.collect())
    assert difference(found, database(folder), ORACLES["stream_ingest"]) == ""
