"""Fusing, judging and presenting retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.codes import LANGUAGE_INSTRUCTIONS, LANGUAGE_NAMES, lookup

RRF_OFFSET = 60

# What the answer model is told.
SYSTEM_PROMPT = (
    "You are an agricultural advisor for Ghanaian farmers. "
    "Answer concisely and practically. If unsure, acknowledge uncertainty. "
    "Never hallucinate facts. Use provided context for accurate advice."
)


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, k: int = 8, offset: int = RRF_OFFSET) -> DataFrame:
    """Fuse two ranked lists (query_id, doc_id, rank) into one of k per question."""
    both = (
        keyword.select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
        .join(semantic.select("query_id", "doc_id", F.col("rank").alias("semantic_rank")), ["query_id", "doc_id"], "full")
    )
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(offset) + F.col(rank)), F.lit(0.0))
    fused = both.withColumn("score", F.round(share("keyword_rank") + share("semantic_rank"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def precision_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the k results of each question that carry the question's label.

    ``results``: query_id, label of the result; ``truth``: query_id, wanted.
    """
    return (
        truth.join(results, "query_id", "left")
        .groupBy("query_id")
        .agg(F.count_if(F.col("label") == F.col("wanted")).alias("hits"))
        .withColumn("precision", F.round(F.col("hits") / F.lit(float(k)), 6))
    )


def overlap_at_k(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Share of each question's k results that both lists have."""
    other = right.select("query_id", "doc_id", F.lit(1).alias("_both"))
    return (
        left.join(other, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(F.count("_both").alias("shared"))
        .withColumn("overlap", F.round(F.col("shared") / F.lit(float(k)), 6))
    )


def context_text(results: DataFrame) -> DataFrame:
    """One context per question: its (at most k) chunks in rank order, each with its source."""
    line = F.concat(F.lit("[source: "), F.col("source"), F.lit("] "), F.col("chunk"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda item: item["line"]), "\n\n").alias("context")
    )


def prompts(questions: DataFrame, contexts: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """One prompt per question (query_id, query, language) from its context."""
    instruction = lookup(LANGUAGE_INSTRUCTIONS, F.col("language"), LANGUAGE_INSTRUCTIONS["en"])
    name = lookup(LANGUAGE_NAMES, F.col("language"), LANGUAGE_NAMES["en"])
    # fixed values: the sentences around question and context
    text = F.concat(
        F.lit(f"{system_prompt}\n\n"), instruction,
        F.lit("\n\nQuestion (may be in "), name, F.lit("): "), F.col("query"),
        F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")),
        F.lit("\n\nProvide a practical and accurate answer in "), name,
        F.lit(", using simple language that farmers can understand. Keep the response under 180 tokens."),
    )
    return questions.join(contexts, "query_id", "left").select("query_id", "language", text.alias("prompt"))
