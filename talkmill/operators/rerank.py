"""Reranking: the fused candidates of a question judged by their texts and chosen one after the other.

A candidate's relevance joins its fused score with how close the question's
terms stand in its text: the share of the terms it holds, times how much of the
smallest stretch of words with all of them they fill. Chunks are then chosen by
maximal marginal relevance: each next one is the most relevant that is least like
those chosen before, so copies and near copies of a chunk do not fill the context.

Only the candidates' texts are read, tokenised in the JVM and sent as numbers; a
group holds one question's candidates, ``pool`` at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import tokens
from talkmill.operators.joins import ROW_BYTES, broadcast_if, measured_bytes
from talkmill.session import ship_package

# Of a candidate's relevance, the share of its fused score; the rest is closeness.
FUSED_SHARE = 0.6
# Of a choice, the weight of relevance against likeness to what is chosen.
BALANCE = 0.7
SCALE = 1e6


def _rounded(value: float) -> float:
    """Six digits, halves away from zero."""
    return math.copysign(math.floor(abs(value) * SCALE + 0.5) / SCALE, value)


def smallest_span(words: np.ndarray, terms: np.ndarray) -> tuple[int, int]:
    """How many of the terms occur among the words, and the fewest consecutive words that hold all of those."""
    places = np.flatnonzero(np.isin(words, terms))
    found = words[places].tolist()
    wanted = len(set(found))
    if not wanted:
        return 0, 0
    held: dict[int, int] = {}
    best, first = len(words), 0
    for last, word in enumerate(found):
        held[word] = held.get(word, 0) + 1
        while len(held) == wanted:
            best = min(best, int(places[last] - places[first]) + 1)
            held[found[first]] -= 1
            if not held[found[first]]:
                del held[found[first]]
            first += 1
    return wanted, best


def _likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    shared = len(np.intersect1d(left, right, assume_unique=True))
    union = len(left) + len(right) - shared
    return shared / union if union else 0.0


def choose(relevance: list[float], sets: list[np.ndarray], k: int, balance: float) -> list[tuple[int, float]]:
    """Places and values of the k candidates chosen by maximal marginal relevance; the earlier one wins a tie."""
    nearest = [0.0] * len(sets)
    left = list(range(len(sets)))
    chosen = []
    while left and len(chosen) < k:
        value = {i: _rounded(balance * relevance[i] - (1 - balance) * nearest[i]) for i in left}
        best = max(left, key=lambda i: (value[i], -i))
        chosen.append((best, value[best]))
        left.remove(best)
        for i in left:
            nearest[i] = max(nearest[i], _likeness(sets[i], sets[best]))
    return chosen


_RESULT = "query_id long, doc_id long, rank int, score double, relevance double, covered int, span int"


def _reranked(k: int, fused_share: float, balance: float):
    """Arrow function: one question's rows (query_id, doc_id, score, terms, words) to its chosen rows."""

    def rerank_one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "descending")])
        score = rows.column("score").to_pylist()
        best = max(score)
        spans, sets, relevance = [], [], []
        for at, sides in enumerate(zip(rows.column("words"), rows.column("terms"))):
            words, terms = (side.values.to_numpy() for side in sides)
            covered, span = smallest_span(words, terms)
            closeness = covered / len(terms) * (covered / span) if covered else 0.0
            spans.append((covered, span))
            sets.append(np.unique(words))
            relevance.append(_rounded(fused_share * (score[at] / best if best else 0.0) + (1 - fused_share) * closeness))
        chosen = choose(relevance, sets, k, balance)
        at = [i for i, _ in chosen]
        return pa.table(
            {
                "query_id": rows.column("query_id").take(at), "doc_id": rows.column("doc_id").take(at),
                "rank": pa.array(range(1, len(at) + 1), pa.int32()), "score": pa.array([value for _, value in chosen], pa.float64()),
                "relevance": pa.array([relevance[i] for i in at], pa.float64()),
                "covered": pa.array([spans[i][0] for i in at], pa.int32()), "span": pa.array([spans[i][1] for i in at], pa.int32()),
            }
        )

    return rerank_one


def rerank(
    candidates: DataFrame, questions: DataFrame, docs: DataFrame, k: int = 8, pool: int = 24, *,
    text: str = "answer", key: str = "id", fused_share: float = FUSED_SHARE, balance: float = BALANCE,
) -> DataFrame:
    """(query_id, doc_id, rank, score, relevance, covered, span): k of the ``pool`` best candidates of every question.

    ``candidates``: query_id, doc_id, score, rank, as fused; ``questions``:
    query_id, query; ``docs``: the collection with ``key`` and ``text``. Values are
    rounded before they are compared; the higher document id wins a tie. A null
    text has no words; a candidate that the collection lacks is left out.
    """
    ship_package(candidates.sparkSession)
    numbers = lambda words: F.transform(words, lambda word: F.xxhash64(word))
    best = candidates.where(F.col("rank") <= pool).select("query_id", "doc_id", "score")
    asked = questions.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("_terms"))
    # pool rows a question
    asked = asked.select("query_id", numbers(F.col("_terms")).alias("terms"))
    wanted = best.join(broadcast_if(asked, measured_bytes(questions, "query")), "query_id")
    # a term takes fewer bytes as a number than twice its text
    size = pool * (2 * measured_bytes(questions, "query") + ROW_BYTES)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    # a question's rows come together before its texts are tokenised, so that all tasks share that work
    met = texts.join(broadcast_if(wanted, size), "doc_id").repartition("query_id")
    rows = met.select(
        F.col("query_id").cast("long").alias("query_id"), "doc_id", F.col("score").cast("double").alias("score"), "terms",
        numbers(tokens(F.col("_text"))).alias("words"),
    )
    return rows.groupBy("query_id").applyInArrow(_reranked(k, fused_share, balance), _RESULT)
