"""Parquet table scans and the message sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread a table with fewer splits than the session has cores, for costly
    work per row. A table with more splits, as any large one, is left as it is
    and not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def with_message_defaults(messages: DataFrame) -> DataFrame:
    """Fill the column defaults a message gets when it is stored."""
    defaults = {
        "message_type": F.lit("text"),
        "language": F.lit("en"),
        "transcribed_text": F.lit(None).cast("string"),
        "audio_file_path": F.lit(None).cast("string"),
        "metadata": F.lit("{}"),
    }
    missing = {name: value for name, value in defaults.items() if name not in messages.columns}
    return messages.withColumns(missing) if missing else messages


def append_messages(messages: DataFrame, path: str) -> None:
    """Append message rows to a parquet message table."""
    with_message_defaults(messages).write.mode("append").parquet(path)
