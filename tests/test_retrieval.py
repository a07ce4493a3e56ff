"""Keyword and vector retrieval on small hand-made collections."""

import math

import pytest
from pyspark.sql import functions as F

from talkmill.operators import joins, retrieval, tfidf, vectors
from talkmill.operators.tfidf import fit, search, search_filled

KB = [
    (0, "How do I control fall armyworm in maize?", "Scout early.", "guide"),
    (1, "When should I plant maize?", "At first rains.", "guide"),
    (2, "What are signs of nitrogen deficiency?", "Pale leaves.", "notes"),
    (3, "How do I control weeds in maize?", "Weed twice.", "notes"),
    (4, "How do I control weeds in maize?", "Weed twice.", "copy"),
]
QUESTIONS = [(1, "maize weeds"), (2, "nitrogen"), (3, "zebra crossing"), (4, ""), (5, "Armyworm, armyworm control!")]


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame(KB, "id long, question string, answer string, source string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


@pytest.fixture(scope="module")
def model(kb):
    return fit(kb)


def _words(text):
    import re

    from talkmill.functions.stopwords import ENGLISH_STOP_WORDS

    return [w for w in re.findall(r"\w\w+", text.lower()) if w not in ENGLISH_STOP_WORDS]


def brute_force(kb_rows, question_rows, k):
    """Plain TF-IDF cosine search."""
    texts = {row[0]: _words(row[1]) for row in kb_rows}
    n = len(texts)
    df = {}
    for words in texts.values():
        for word in set(words):
            df[word] = df.get(word, 0) + 1
    idf = {word: math.log((1 + n) / (1 + count)) + 1 for word, count in df.items()}

    def unit(words):
        raw = {}
        for word in words:
            if word in idf:
                raw[word] = raw.get(word, 0) + idf[word]
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {word: w / length for word, w in raw.items()}

    docs = {doc: unit(words) for doc, words in texts.items()}
    expected = {}
    for query_id, query in question_rows:
        asked = unit(_words(query))
        scores = [(round(sum(w * d.get(t, 0) for t, w in asked.items()), 6), doc) for doc, d in docs.items()]
        ranked = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], -s[1]))[:k]
        expected[query_id] = [(doc, score) for score, doc in ranked]
    return {query: hits for query, hits in expected.items() if hits}


def as_lists(results):
    found = {}
    for row in results.orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.doc_id, row.score))
    return found


def test_search_equals_brute_force(model, questions):
    assert as_lists(search(model, questions, 3)) == brute_force(KB, QUESTIONS, 3)


def test_search_is_sorted_and_limited(model, questions):
    for hits in as_lists(search(model, questions, 2)).values():
        assert len(hits) <= 2
        assert [score for _, score in hits] == sorted((score for _, score in hits), reverse=True)


def test_equal_scores_take_the_higher_id_first(model, questions):
    assert [doc for doc, _ in as_lists(search(model, questions, 5))[1]][:2] == [4, 3]


def test_empty_question_gives_nothing_and_unknown_terms_are_filled(model, questions, kb):
    filled = as_lists(search_filled(model, questions, kb, 3))
    assert 4 not in filled
    assert filled[3] == [(4, 0.0), (3, 0.0), (2, 0.0)]
    assert filled[2] == [(2, 1.0), (4, 0.0), (3, 0.0)] or filled[2][0][0] == 2
    everything = as_lists(search_filled(model, questions, kb, 50))
    assert all(len(hits) == len(KB) for hits in everything.values())


def test_empty_collection(spark, questions):
    empty = fit(spark.createDataFrame([], "id long, question string"))
    assert search(empty, questions, 3).count() == 0


def test_hot_terms_beyond_the_broadcast_limit(spark, monkeypatch):
    """One term in every document, nothing broadcast: same result through salted shuffles."""
    rows = [(i, f"maize {'soil' if i % 3 else 'water'} number{i} topic{i % 7}", "a", "s") for i in range(120)]
    asked = [(q, f"maize soil topic{q}") for q in range(7)]
    expected = brute_force(rows, asked, 4)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tfidf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tfidf, "HOT_TERMS", 5)
    kb = spark.createDataFrame(rows, "id long, question string, answer string, source string")
    model = fit(kb)
    assert {row.term for row in model.hot_terms().collect()} >= {"maize"}
    assert as_lists(search(model, spark.createDataFrame(asked, "query_id long, query string"), 4)) == expected


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("seed", range(2))
def test_pruned_search_equals_brute_force(spark, monkeypatch, broadcast, seed):
    """Skewed vocabulary with very frequent terms in documents and questions, and exact copies."""
    import random

    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(pick.choices(vocabulary, odds, k=pick.randrange(1, 25))), "a", "s") for i in range(250)]
    rows += [(250 + i, rows[7][1], "a", "s") for i in range(40)]
    asked = [(q, " ".join(pick.choices(vocabulary, odds, k=pick.randrange(1, 9)))) for q in range(40)]
    monkeypatch.setattr(tfidf, "DIRECT_PAIRS_PER_TASK", 0)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(tfidf, "BROADCAST_BYTES", broadcast)
    model = fit(spark.createDataFrame(rows, "id long, question string, answer string, source string"))
    found = as_lists(search(model, spark.createDataFrame(asked, "query_id long, query string"), 5))
    assert found == brute_force(rows, asked, 5)


def test_scores_are_not_shuffled_per_pair(model, questions):
    plan = search(model, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert "hashpartitioning(query_id#" not in plan.split("WindowGroupLimit")[-1].split("BroadcastHashJoin")[0]


def test_context_and_prompt(spark):
    results = spark.createDataFrame(
        [(1, 2, "second", "b"), (1, 1, "first", "a")], "query_id long, rank int, chunk string, source string"
    )
    contexts = retrieval.context_text(results)
    assert contexts.first().context == "[source: a] first\n\n[source: b] second"
    asked = spark.createDataFrame([(1, "q?", "tw"), (2, "r?", "xx")], "query_id long, query string, language string")
    prompts = {row.query_id: row.prompt for row in retrieval.prompts(asked, contexts).collect()}
    assert "Respond in Twi (Akan language)." in prompts[1] and "(may be in Twi): q?" in prompts[1]
    assert "Respond in English." in prompts[2] and prompts[2].count("Context:\n\n") == 1


def test_rank_fusion(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    right = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    fused = retrieval.reciprocal_rank_fusion(left, right, 2).orderBy("rank").collect()
    assert [(row.doc_id, row.score) for row in fused] == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]


# Vectors

VECTORS = [
    (1, [1.0, 0.0], 7), (2, [0.0, 1.0], 7), (3, [2.0, 0.0], 8), (4, [0.0, 0.0], 8), (5, None, 7), (6, [1.0, 1.0], None),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(VECTORS, "id long, embedding array<float>, user_id long")


@pytest.fixture(scope="module")
def wanted(spark):
    return spark.createDataFrame(
        [(100, [1.0, 0.0], 7), (101, [1.0, 0.0], None)], "query_id long, embedding array<float>, user_id long"
    )


def _hits(results, query):
    return [row.id for row in results.where(F.col("query_id") == query).orderBy("rank").collect()]


def test_nearest_first_ties_by_id_and_no_direction_last(stored, wanted):
    results = vectors.vector_topk(stored, wanted, 10)
    assert _hits(results, 100) == [1, 3, 6, 2, 4]
    last = results.where("query_id = 100 and rank = 5").first()
    assert math.isnan(last.distance)


def test_user_filter(stored, wanted):
    results = vectors.vector_topk(stored, wanted, 10, by_user=True)
    assert _hits(results, 100) == [1, 2]
    assert _hits(results, 101) == [1, 3, 6, 2, 4]


@pytest.mark.parametrize("bad", [[1.0, 2.0, 3.0], [1.0, None], []])
def test_vectors_of_another_width_are_an_error(spark, stored, wanted, bad):
    schema = "id long, embedding array<float>, user_id long"
    mixed = spark.createDataFrame([(50, bad, 1)], schema)
    with pytest.raises(Exception, match="does not hold"):
        vectors.vector_topk(stored.select("id", "embedding", "user_id").union(mixed), wanted, 3).collect()


def test_many_question_groups_never_shuffle_the_collection(spark, monkeypatch):
    import numpy as np

    numbers = np.random.default_rng(3)
    corpus, asked = numbers.normal(size=(300, 8)).astype("float32"), numbers.normal(size=(90, 8)).astype("float32")
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(vectors, "QUERY_BLOCK_ROWS", 16)
    stored = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(corpus)], "id long, embedding array<float>, user_id long")
    wanted = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(asked)], "query_id long, embedding array<float>, user_id long")
    a = asked.astype("float64") / np.linalg.norm(asked.astype("float64"), axis=1)[:, None]
    b = corpus.astype("float64") / np.linalg.norm(corpus.astype("float64"), axis=1)[:, None]
    distances = np.round(1 - a @ b.T, 6)
    expected = {q: [int(i) for i in np.lexsort((np.arange(300), distances[q]))[:3]] for q in range(90)}
    found = {}
    for row in vectors.vector_topk(stored, wanted, 3).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append(row.id)
    assert found == expected
    plan = vectors.vector_topk(stored, wanted, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_saved_model_is_found_again(spark):
    kb = spark.createDataFrame([(1, "maize pests"), (2, "rice water"), (3, "maize water")], "id long, question string")
    model = tfidf.fit(kb)
    asked = spark.createDataFrame([(1, "maize water")], "query_id long, query string")
    again = tfidf.load(spark.newSession(), model.folder)
    rows = [tuple(r) for r in tfidf.search(model, asked, 2).collect()]
    other = tfidf.search(again, again.idf.sparkSession.createDataFrame([(1, "maize water")], "query_id long, query string"), 2)
    assert [tuple(r) for r in other.collect()] == rows and rows
    again.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(f"{model.folder}/idf").count()


def test_inverted_lists_recall(spark):
    import numpy as np

    numbers = np.random.default_rng(5)
    centres = numbers.normal(size=(10, 16)) * 3
    points = (centres[np.arange(600) % 10] + numbers.normal(size=(600, 16))).astype("float32")
    stored = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(points)], "id long, embedding array<float>, user_id long")
    wanted = stored.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.vector_topk(stored, wanted, 5).collect()}
    lists = vectors.InvertedLists(stored, lists=10)
    some = {(r.query_id, r.id) for r in lists.search(wanted, 5, probes=3).collect()}
    assert len(exact & some) / len(exact) >= 0.8
    assert {(r.query_id, r.id) for r in lists.search(wanted, 5, probes=10).collect()} == exact
    plan = lists.search(wanted.limit(1), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "PartitionFilters: [(list_id" in plan


def test_probes_follow_the_number_of_lists(spark):
    import numpy as np

    points = np.random.default_rng(8).normal(size=(900, 16)).astype("float32")
    stored = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(points)], "id long, embedding array<float>, user_id long")
    wanted = stored.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.vector_topk(stored, wanted, 5).collect()}
    lists = vectors.InvertedLists(stored)
    found = {(r.query_id, r.id) for r in lists.search(wanted, 5).collect()}
    assert lists.lists == 30 and len(exact & found) / len(exact) >= 0.9


def test_recall_query_runs_the_search_of_the_index_query(spark, data, monkeypatch):
    from talkmill.plans import catalog

    calls = []
    search = vectors.InvertedLists.search
    monkeypatch.setattr(vectors.InvertedLists, "search", lambda self, *args, **more: calls.append((self.lists, args[1:], more)) or search(self, *args, **more))
    catalog.QUERIES["vector_ivf"](spark, data)
    catalog.QUERIES["vector_ivf_recall"](spark, data)
    assert calls[0] == calls[1]


def clustered(n=6000, clusters=60, width=24):
    import numpy as np

    numbers = np.random.default_rng(11)
    centres = numbers.normal(size=(clusters, width)) * 4
    return (centres[np.arange(n) % clusters] + numbers.normal(size=(n, width)) * 0.5).astype("float32")


def test_bounds_find_the_exact_neighbours_and_read_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RING_ROWS", 32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(clustered())]
    rows += [(10_000, [0.0] * 24, 0), (10_001, None, 0), (10_002, rows[7][1], 1)]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>, user_id long")
    wanted = stored.where("id % 100 = 7 or id >= 10000").withColumnRenamed("id", "query_id")
    index = vectors.InvertedLists(stored)
    again = vectors.InvertedLists.load(spark, index.folder)
    assert again.lists == index.lists and again.rows == index.rows == 6002
    key = lambda df: sorted((r.query_id, r["rank"], r.id, str(r.distance)) for r in df.collect())
    assert key(again.search(wanted, 5)) == key(vectors.vector_topk(stored, wanted, 5))
    directed = wanted.where("query_id < 10000")
    read = again.rows_read(directed, 5).collect()
    assert len(read) == 60 and all(r.rows == 6002 for r in read)
    assert max(r.rows_compared for r in read) < 6002 / 2 and sum(r.rows_compared for r in read) < 60 * 6002 / 10
    # the pairs left are few, so no scan of everything
    _, pairs = again.plan(directed, 5)
    assert pairs.count() <= vectors.SCAN_SHARE * 60 * again.blocks
    some = {(r.query_id, r.id) for r in again.search(directed, 5, slack=1.0).collect()}
    exact = {(r.query_id, r.id) for r in vectors.vector_topk(stored, directed, 5).collect()}
    assert len(some & exact) >= 0.9 * len(exact)
    assert sum(r.rows_compared for r in again.rows_read(directed, 5, slack=1.0).collect()) <= sum(r.rows_compared for r in read)


def test_index_without_clusters_few_vectors_or_none(spark):
    import numpy as np

    points = np.random.default_rng(3).normal(size=(300, 16)).astype("float32")
    stored = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(points)], "id long, embedding array<float>, user_id long")
    wanted = stored.where("id < 9").withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    assert key(vectors.InvertedLists(stored).search(wanted, 4)) == key(vectors.vector_topk(stored, wanted, 4))
    few = stored.limit(3)
    assert key(vectors.InvertedLists(few, lists=2).search(wanted, 5)) == key(vectors.vector_topk(few, wanted, 5))
    assert vectors.InvertedLists(stored, lists=4).search(wanted.limit(0), 5).count() == 0


def test_buckets_follow_the_bytes_of_the_texts(spark):
    """A task holds one bucket, so its memory must not grow with the collection."""
    texts = spark.range(8).select("id", F.expr("repeat('maize soil water ', 250000)").alias("question"))
    wide = fit(texts)
    assert wide.buckets >= 4
    assert len({row.bucket for row in wide.weights.select(F.input_file_name().alias("bucket")).distinct().collect()}) >= 3
    assert [(row.term, round(row.weight, 6)) for row in wide.weights.where("doc_id = 3").orderBy("term").collect()] == [
        (term, 0.57735) for term in ("maize", "soil", "water")
    ]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_block_search_equals_brute_force(spark, monkeypatch, k):
    """Blocks of documents and questions, sums in several groups, exact copies across blocks."""
    import random

    pick = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(pick.choices(vocabulary, odds, k=pick.randrange(1, 25))), "a", "s") for i in range(250)]
    rows += [(250 + i, rows[7][1], "a", "s") for i in range(40)]
    asked = [(q, " ".join(pick.choices(vocabulary, odds, k=pick.randrange(1, 9)))) for q in range(40)]
    monkeypatch.setattr(tfidf, "BLOCK_QUESTIONS", 16)
    model = fit(spark.createDataFrame(rows, "id long, question string, answer string, source string"))
    found = search(model, spark.createDataFrame(asked, "query_id long, query string"), k)
    assert as_lists(found) == brute_force(rows, asked, k)
    # no exchange of the weights and none of the pairs
    assert "Exchange hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_best_pairs_in_small_groups(monkeypatch):
    """Few products at a time; terms that no question has, null ids and ties."""
    import pyarrow as pa

    monkeypatch.setattr(tfidf, "PRODUCTS", 2)
    held = lambda *pairs: [{"number": n, "weight": w} for n, w in pairs]
    docs = pa.array(
        [{"doc_id": d, "held": h} for d, h in (
            (4, held((1, 0.6), (9, 0.8))), (7, held((1, 0.6), (5, 0.8))), (None, held((1, 0.6))), (2, held((9, 1.0))),
            (5, held((5, 1.0))),
        )],
        pa.struct({"doc_id": pa.int64(), "held": pa.list_(pa.struct({"number": pa.int64(), "weight": pa.float64()}))}),
    )
    asked = pa.array(
        [{"query_id": q, "number": n, "wq": w} for q, n, w in ((None, 5, 1.0), (1, 1, 0.5), (1, 5, 0.5), (2, 3, 1.0))],
        pa.struct({"query_id": pa.int64(), "number": pa.int64(), "wq": pa.float64()}),
    )
    pairs = lambda k: sorted(zip(*(side.to_pylist() for side in tfidf._best_pairs(docs, asked, k))), key=str)
    assert pairs(9) == sorted(
        [(None, 5, 1.0), (None, 7, 0.8), (1, 7, 0.7), (1, 5, 0.5), (1, 4, 0.3), (1, None, 0.3)], key=str
    )
    assert pairs(3) == sorted([(None, 5, 1.0), (None, 7, 0.8), (1, 7, 0.7), (1, 5, 0.5), (1, 4, 0.3)], key=str)
