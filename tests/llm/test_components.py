"""Connected components: results, and where the rounds run."""

import random

import pytest

from talkmill.llm import components as c


def plain(edges):
    top = {}
    for a, b in edges:
        for x in (a, b):
            top.setdefault(x, x)
        a, b = top[a], top[b]
        top = {x: min(a, b) if t in (a, b) else t for x, t in top.items()}
    return top


@pytest.mark.parametrize("most", [0, 200_000])
def test_equals_plain_code(spark, monkeypatch, most):
    monkeypatch.setattr(c, "SMALL_EDGES", most)
    rng = random.Random(most)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    edges = [(a, b) for a, b in edges if a != b]
    found = c.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(plain(edges).items())


@pytest.mark.parametrize("most, shuffled", [(0, True), (200_000, False)])
def test_few_edges_are_shuffled_no_more(spark, monkeypatch, most, shuffled):
    plans, cut = [], c.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(c, "SMALL_EDGES", most)
    monkeypatch.setattr(c, "cut_lineage", noted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long").repartition(3)
    c.components(edges)
    rounds = [p for p in plans if "Join" in p or "Window" in p]
    assert len(rounds) > 2
    assert ["Exchange hashpartitioning" in p for p in rounds] == [shuffled] * len(rounds)
