"""Reranking against plain code: spans, greedy choice, copies, ties and empty texts."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.functions.stopwords import ENGLISH_STOP_WORDS
from talkmill.operators import metrics
from talkmill.operators.rerank import BALANCE, FUSED_SHARE, choose, rerank, smallest_span


def test_smallest_span_is_that_of_all_stretches():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.randint(0, 8) for _ in range(rng.randint(0, 25))]
        terms = rng.sample(range(12), rng.randint(1, 5))
        found = set(words) & set(terms)
        spans = [j - i for i, j in itertools.combinations(range(len(words) + 1), 2) if found <= set(words[i:j])]
        assert smallest_span(np.array(words, np.int64), np.array(terms, np.int64)) == (len(found), min(spans) if found else 0)


def plain(candidates, query, texts, k):
    split = lambda t: [w for w in (t or "").split() if len(w) > 1 and w not in ENGLISH_STOP_WORDS]
    terms = set(split(query))
    best = max(s for _, s in candidates)
    rel, sets = {}, {}
    for doc, score in candidates:
        words = split(texts[doc])
        covered, span = smallest_span(np.array([hash(w) for w in words], np.int64), np.array([hash(w) for w in terms], np.int64))
        rel[doc] = round(FUSED_SHARE * score / best + (1 - FUSED_SHARE) * (covered / len(terms) * covered / span if covered else 0), 6)
        sets[doc] = set(words)
    chosen = []
    while len(chosen) < min(k, len(candidates)):
        def value(doc):
            alike = max((len(sets[doc] & sets[c]) / max(1, len(sets[doc] | sets[c])) for c in chosen), default=0)
            return round(BALANCE * rel[doc] - (1 - BALANCE) * alike, 6), doc
        chosen.append(max((d for d in rel if d not in chosen), key=value))
    return chosen


def test_choice_is_the_greedy_one_and_copies_wait(spark):
    rng = random.Random(6)
    vocabulary = [f"word{n}" for n in range(40)]
    texts = {d: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) for d in range(30)}
    texts |= {30: texts[3], 31: texts[3], 32: None, 33: ""}
    queries = {q: " ".join(rng.sample(vocabulary, 6)) for q in range(5)}
    lists = {q: [(d, round(0.04 - 0.0007 * r, 6)) for r, d in enumerate(rng.sample(sorted(texts), 16))] for q in queries}
    lists[5] = [(3, 0.03), (30, 0.03), (31, 0.03), (7, 0.028)]
    queries[5] = "word1 word2"
    candidates = spark.createDataFrame(
        [(q, d, s, r) for q, rows in lists.items() for r, (d, s) in enumerate(rows, 1)], "query_id long, doc_id long, score double, rank int"
    )
    found = rerank(
        candidates, spark.createDataFrame(list(queries.items()), "query_id long, query string"),
        spark.createDataFrame(list(texts.items()), "id long, answer string"), k=6, pool=16,
    ).collect()
    for q, rows in lists.items():
        got = [r.doc_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert got == plain(rows, queries[q], texts, 6)
    # of three copies the highest id comes first, and another text before the second one
    assert [r.doc_id for r in sorted((r for r in found if r.query_id == 5), key=lambda r: r["rank"])][:2] == [31, 7]


def test_only_the_pool_is_read(spark):
    docs = spark.createDataFrame([(d, f"maize text {d}") for d in range(50)], "id long, answer string")
    candidates = spark.createDataFrame([(1, d, 1.0 / (d + 1), d + 1) for d in range(50)], "query_id long, doc_id long, score double, rank int")
    asked = spark.createDataFrame([(1, "maize")], "query_id long, query string")
    assert {r.doc_id for r in rerank(candidates, asked, docs, k=50, pool=9).collect()} == set(range(9))
    assert rerank(candidates.limit(0), asked, docs).count() == 0


def test_choice_of_nothing_and_of_equal_ones():
    assert choose([], [], 3, 0.7) == []
    empty = np.zeros(0, np.int64)
    assert [i for i, _ in choose([0.5, 0.5, 0.9], [empty] * 3, 2, 0.7)] == [2, 0]


T0 = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("widths", [{"a": 1}, {"a": 3, "b": 24, "c": 500}])
def test_sliding_widths_equal_a_count_of_every_window(spark, widths):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), T0 + dt.timedelta(minutes=rng.randint(0, 60 * 40))) for _ in range(120)]
    rows += [(9, T0 + dt.timedelta(days=60)), (9, T0 + dt.timedelta(days=60)), (4, None), (5, dt.datetime(1969, 12, 31, 23, 30))]
    expected = {}
    for name, n in widths.items():
        seen = {}
        for user, ts in rows:
            if ts is not None and user is not None:
                hour = ts.replace(minute=0)
                for h in range(n):
                    seen.setdefault(hour - dt.timedelta(hours=h), set()).add(user)
        expected |= {(name, start): len(users) for start, users in seen.items()}
    frame = spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz")
    found = metrics.active_sliding_widths(frame, "user_id", "created_at", widths).collect()
    assert {(r.width, r.window_start): r.active_users for r in found} == expected and len(found) == len(expected)


def test_sliding_cost_does_not_follow_the_width(spark):
    """No step makes more rows than two for each user, slot and width, however wide."""
    rows = [(u, T0 + dt.timedelta(hours=13 * u + 3 * k)) for u in range(40) for k in range(5)]
    frame = spark.createDataFrame(rows, "user_id long, created_at timestamp_ntz")
    plans = []
    for n in (24, 720):
        found = metrics.active_sliding_widths(frame, "user_id", "created_at", {"w": n})
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 3 and "Expand" not in plan  # widths, two events, hours between events
        plans.append(found.agg(F.count(F.lit(1))).first()[0])
    assert plans[1] - plans[0] == 720 - 24  # only the time line is longer
