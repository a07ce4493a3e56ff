"""The question/answer knowledge base: CSV files, snapshots and upkeep."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions.text import normalised
from talkmill.operators.joins import ROW_BYTES, broadcast_if
from talkmill.schemas import KNOWLEDGE_BASE
from talkmill.session import cut_lineage
from talkmill.sources.tables import spread

DEFAULT_SOURCE = "csv:knowledge_base"
# Fixed values.
BATCH_ROWS = 20
TARGET_ROWS = 250

_CSV = {
    "header": True, "quote": '"', "escape": '"', "quoteAll": True, "emptyValue": "", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def normalise(kb: DataFrame, default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """Require question and answer; a collection without source gets a default one."""
    missing = {"question", "answer"} - set(kb.columns)
    if missing:
        raise ValueError("a knowledge base needs 'question' and 'answer' columns")
    return kb if "source" in kb.columns else kb.withColumn("source", F.lit(default_source))


def read_csv(spark: SparkSession, path: str, default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """Read a knowledge base from CSV with quoted commas, quotes and line ends.

    A path that does not exist gives an empty collection.
    """
    try:
        raw = spark.read.options(**_CSV, multiLine=True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KNOWLEDGE_BASE)
    return normalise(raw, default_source).select(*KNOWLEDGE_BASE.names)


def append_csv(kb: DataFrame, path: str) -> None:
    """Append rows with every field quoted."""
    kb.select(*KNOWLEDGE_BASE.names).write.mode("append").options(**_CSV).csv(path)


def write_snapshot(kb: DataFrame, path: str, stamp: str) -> None:
    """Keep a copy under a timestamp (``yyyyMMdd_HHmmss``); other snapshots stay."""
    kb.write.mode("overwrite").parquet(f"{path}/snapshot_ts={stamp}")


def read_snapshot(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot_ts={stamp}")


def target_reached(kb: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    return kb.agg(F.count(F.lit(1)).alias("total")).withColumn("reached", F.col("total") >= target)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Add ``row_number`` (from 1) over the whole table without one task sorting it all.

    The table is range-partitioned and sorted, checkpointed so that positions
    cannot move on a retry, and the partition sizes (one row per partition)
    give each partition its offset.
    """
    placed = cut_lineage(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("row_number", F.col("_offset") + within + 1)
        .drop("_part", "_at", "_offset")
    )


def append_batches(kb: DataFrame, order: str = "id", size: int = BATCH_ROWS) -> DataFrame:
    """The batches of ``size`` rows in which rows are appended."""
    batch = F.floor((F.col("row_number") - 1) / size) + 1
    return (
        numbered(kb.select(order), order)
        .groupBy(batch.cast("long").alias("batch_no"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))
    )


def dedup(kb: DataFrame, order: str = "id") -> DataFrame:
    """Keep the first entry of every question, spelling case and spacing aside.

    Copies meet as (digest, smallest id), so many copies of one text neither
    travel nor gather in one task.
    """
    digest = F.sha2(normalised(F.col("question")), 256)
    first = spread(kb.select(order, "question"), order).groupBy(digest.alias("_digest")).agg(F.min(order).alias(order)).select(order)
    return kb.join(first, order, "left_semi")


def damaged(kb: DataFrame) -> DataFrame:
    """Entries with a question mark between two letters: letters lost to a wrong encoding."""
    broken = r"\p{L}\?\p{L}"
    return kb.where(F.col("question").rlike(broken)).withColumn(
        "damaged_places", F.regexp_count("question", F.lit(broken)).cast("long")
    )


def snapshot_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Questions added and removed between two snapshots, with their number.

    Same rows as the two multiset differences. Copies are counted map-side with
    a sign, by digest; only texts of questions that changed are looked up.
    """
    digest = F.sha2(F.col("question"), 256).alias("_digest")
    both = older.select("question", F.lit(-1).alias("n")).unionByName(newer.select("question", F.lit(1).alias("n")))
    change = both.groupBy(digest).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    change = cut_lineage(change.withColumnRenamed("_digest", "_changed"))
    changed = both.select(digest, "question").join(
        broadcast_if(change, 3 * ROW_BYTES * change.count()), F.col("_digest").eqNullSafe(F.col("_changed"))
    )
    texts = changed.groupBy("_digest").agg(F.first("question").alias("question"), F.first("n").alias("n"))
    return texts.select(
        F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), "question", F.abs("n").alias("copies")
    )
