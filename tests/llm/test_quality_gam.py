"""The additive model: learning, held-out accuracy, edges."""

import numpy as np
from pyspark.sql import functions as F

from talkmill.llm import quality_gam
from talkmill.llm.catalog import op9_quality_classifier


def test_learns_single_features_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.3) & ((x[:, 1] > 0.5) == (x[:, 2] > 0.5))).astype(float)
    model = quality_gam.Gam.fit(x[:3000], y[:3000])
    right = (model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)
    assert right.mean() > 0.9 and (1, 2) in model.pairs


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, len(quality_gam.FEATURES))), rng.integers(0, 2, 500).astype(float)
    model = quality_gam.Gam.fit(x, y)
    row = x[7]
    total = model.base
    for k, (table, edges) in enumerate(zip(model.tables, model.edges)):
        total += table[int((row[k] >= edges).sum())]
    for (a, b), table in model.pairs.items():
        total += table[int((row[a] >= model.pair_edges[a]).sum()), int((row[b] >= model.pair_edges[b]).sum())]
    assert np.isclose(model.score(x[7:8])[0], 1 / (1 + np.exp(-total)))


def test_held_out_accuracy_and_columns(spark, data):
    rows = op9_quality_classifier(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.9
    low, high, bad = rows.agg(F.min("score"), F.max("score"), F.sum(((F.col("score") >= 0.5) != (F.col("predicted") == 1)).cast("int"))).first()
    assert 0 <= low <= high <= 1 and bad == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "z " * 50_000, "d"), (3, "z", "e")],
                                 "doc_id long, text string, _x string")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    kept = quality_gam.score(docs, quality_gam.train(docs, labels), "doc_id", "_x")
    assert kept.columns == ["doc_id", "_x", "_score"] and kept.count() == 5
    untaught = quality_gam.score(docs, quality_gam.train(docs, labels.limit(0)), "doc_id")
    assert {r._score for r in untaught.collect()} == {0.5}
    good = quality_gam.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert quality_gam.keep_good(docs.limit(0), labels).count() == 0
