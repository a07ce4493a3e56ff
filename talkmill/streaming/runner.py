"""Running a stream to the end of what is available and reading its result.

Streams keep their state in RocksDB with its log in the query's checkpoint
folder, so a lost executor's state is rebuilt from the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.schemas import EVENTS
from talkmill.session import scratch_path

WATERMARK = "10 minutes"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions of one key are merged before the shuffle, so a busy sender sends few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application with the settings streams need.

    State partitions cannot change later: a job that has to outgrow the session's
    ``spark.sql.shuffle.partitions`` names its own number before its first run.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    shuffles = "spark.sql.shuffle.partitions"
    session.conf.set(shuffles, str(partitions or spark.conf.get(shuffles)))
    for key, value in _STATE.items():
        session.conf.set(key, value)
    return session


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files; event time as a zoned timestamp for watermarks."""
    return (
        stream_session(spark)
        .readStream.schema(EVENTS)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def append_available(stream: DataFrame, path: str) -> None:
    """Append what the stream has finished to a parquet table, each row exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def result_of(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is available and scan its table."""
    path = scratch_path(spark, name)
    append_available(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
