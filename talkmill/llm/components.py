"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.session import cut_lineage


# So many edges fit into one task many times over, and need no shuffle there.
SMALL_EDGES = 200_000


def _settled(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Checkpointed edges, and whether their number is small; then they are in one partition."""
    kept = cut_lineage(edges)
    small = kept.count() <= SMALL_EDGES
    if small and kept.rdd.getNumPartitions() > 1:
        kept = cut_lineage(kept.coalesce(1))
    return kept, small


def _with_least(rows: DataFrame, in_one_task: bool) -> DataFrame:
    """Rows (a, b) with m, the smallest b of their a."""
    if in_one_task:
        # a join would be shuffled for more parallelism
        return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return rows.join(rows.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it is connected with.

    Alternates two steps until nothing changes, about log(nodes) times: every
    node sends its larger neighbours to the smallest node it knows, then the
    others. Minima are combined before each shuffle and a node with very many
    neighbours is a skewed join side, which adaptive execution splits; nothing
    is collected. A small number of edges, which is counted, stays in one task.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    current, in_one_task = _settled(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        if in_one_task:
            # a checkpoint forgets that it has one partition, and every round would be shuffled again
            current = current.coalesce(1)
        both = current.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        large = _with_least(both, in_one_task).withColumn("m", F.least("a", "m")).where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large, in_one_task).select(F.inline(F.array(pair("a", "m"), pair("b", "m"))))
        current = cut_lineage(small.where("a <> b").distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return current.select(
        F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")),
                         F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))
    ).distinct()
