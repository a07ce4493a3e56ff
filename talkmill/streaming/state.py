"""Latest state per sender as a stateful stream: value state, an event-time timer for expiry, and a table of changes.

Each sender's newest answered message is one value in the state store. A timer
stands at its time plus ``ttl``; a newer message moves it. When the watermark
passes the timer, the sender is emitted as expired and the value is dropped, so
the state holds the senders of the last ``ttl`` only.

Before the shuffle every Arrow batch is cut to the newest message of each sender, so
a very busy sender sends a row per batch.

What comes out of a micro-batch are the senders that changed. They are written
as they are, under the batch's number, so a repeated batch replaces itself. A
snapshot is merged from them only when the changes since the last one reach
``MERGE_SHARE`` of its bytes: over time at most ``1 + 1 / MERGE_SHARE`` times the
bytes of the changes are written, however many senders there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkmill.session import ship_package

MERGE_SHARE = 0.5
_MESSAGE = "body string, response string, route string, us long, event_id long"
CHANGE = f"sender string, {_MESSAGE}, expired boolean"


def _newest_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest message of every sender in each Arrow batch."""
    for batch in batches:
        newest: dict[str, tuple] = {}
        keys = zip(*(batch.column(name).to_pylist() for name in ("sender", "us", "event_id")))
        for at, (sender, *order) in enumerate(keys):
            newest[sender] = max(newest.get(sender, (order, at)), (order, at))
        yield batch.take(pa.array(sorted(at for _, at in newest.values()), pa.int64()))


class NewestMessage(StatefulProcessor):
    """One sender's newest message; emits it when it changes and again, as expired, when its time is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _MESSAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = tuple(self.newest.get()) if self.newest.exists() else None
        best = known
        for row in rows:
            seen = (row.body, row.response, row.route, row.us, row.event_id)
            if best is None or seen[3:] > best[3:]:
                best = seen
        if best == known:
            return
        if known is not None:
            self.handle.deleteTimer(self._due(known))
        self.newest.update(best)
        self.handle.registerTimer(self._due(best))
        yield self._change(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists():
            gone = tuple(self.newest.get())
            self.newest.clear()
            yield self._change(key, gone, True)

    def close(self) -> None:
        pass

    def _due(self, message: tuple) -> int:
        return message[3] // 1000 + self.ttl_ms

    @staticmethod
    def _change(key, message: tuple, expired: bool) -> Row:
        body, response, route, us, event_id = message
        return Row(sender=key[0], body=body, response=response, route=route, us=us, event_id=event_id, expired=expired)


def changes(routed: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """The stream of changes (sender, body, response, route, us, event_id, expired) of routed, answered messages.

    Messages without a response or a time change nothing.
    """
    ship_package(routed.sparkSession)
    answered = routed.where(F.col("response").isNotNull() & F.col("ts").isNotNull()).select(
        "sender", "body", "response", "route", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id")
    )
    newest = answered.mapInArrow(_newest_of_batch, f"sender string, {_MESSAGE}")
    timed = newest.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    return timed.groupBy("sender").transformWithState(NewestMessage(ttl_seconds * 1000), CHANGE, "update", "eventTime")


class ChangeTable:
    """The newest row per sender, kept as a snapshot and the changes since, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        folder = self.hadoop.Path(f"{self.path}/{kind}")
        if not self.files.exists(folder):
            return []
        done = (f.getPath() for f in self.files.listStatus(folder))
        return sorted(int(p.getName().split("=")[1]) for p in done if self.files.exists(self.hadoop.Path(p, "_SUCCESS")))

    def _bytes(self, kind: str, numbers: list[int]) -> int:
        size = lambda n: self.files.getContentSummary(self.hadoop.Path(f"{self.path}/{kind}/batch={n}")).getLength()
        return sum(size(n) for n in numbers)

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(*[f"{self.path}/{kind}/batch={n}" for n in numbers])

    def _parts(self) -> tuple[list[int], list[int]]:
        """The snapshot to read, if any, and the changes after it."""
        snapshots = self._numbers("rows")[-1:]
        return snapshots, [n for n in self._numbers("changes") if not snapshots or n > snapshots[0]]

    def add(self, batch: DataFrame, number: int) -> None:
        """Write a micro-batch's changes; merge them into a snapshot when they are many."""
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        snapshots, recent = self._parts()
        if self._bytes("changes", recent) >= MERGE_SHARE * self._bytes("rows", snapshots):
            self._merged(snapshots, recent).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
            self._drop_before(number)

    def _drop_before(self, number: int) -> None:
        """Forget what the snapshot replaces; the one before stays for readers that have begun."""
        old = [n for n in self._numbers("rows") if n < number]
        for n in old[:-1]:
            self.files.delete(self.hadoop.Path(f"{self.path}/rows/batch={n}"), True)
        for n in self._numbers("changes"):
            if old and n <= old[-1]:
                self.files.delete(self.hadoop.Path(f"{self.path}/changes/batch={n}"), True)

    def _merged(self, snapshots: list[int], recent: list[int]) -> DataFrame:
        parts = [self._read(kind, numbers) for kind, numbers in (("rows", snapshots), ("changes", recent)) if numbers]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        # an expiry comes after the message it ends
        newest = F.max_by(F.struct("body", "response", "route", "us", "event_id", "expired"), F.struct("us", "event_id", "expired"))
        return rows.groupBy("sender").agg(newest.alias("s")).select("sender", "s.*")

    def read(self) -> DataFrame:
        """The newest row of every sender."""
        snapshots, recent = self._parts()
        if not snapshots and not recent:
            return self.spark.createDataFrame([], CHANGE)
        return self._merged(snapshots, recent) if recent else self._read("rows", snapshots)
