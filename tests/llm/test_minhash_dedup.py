"""MinHash near-duplicates against plain sets: components, kept rows, and the parts of the verification."""

import random

import numpy as np
import pytest

from talkmill.llm import minhash_dedup
from talkmill.llm.minhash_dedup import BANDS, BATCH, HASHES, LINK, MISS, ROWS, MinHashDedup, least_matches, minima, near_duplicates, survivors


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), name, name is None or doc_id == name))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def sample():
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    rows = []
    for _ in range(25):  # groups of near copies around the threshold
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 1, " ".join(copy)))
    base = [word() for _ in range(200)]
    for _ in range(60):  # a large group that falls into several components
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 6, 7, 8])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(2000 + k, " ".join(word() for _ in range(60))) for k in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \x0b"), (3003, "one"), (3004, "One"), (3005, "a b"), (3006, "a b c"), (3007, "a b c a b c")]
    rows += [(None, rows[5][1]), (None, "no id at all, twice"), (None, "no id at all, twice"), (None, None)]
    rows += [rows[40]] * 5 + [(rows[41][0], " ".join(word() for _ in range(40))), (3100, "z " * 30_000), (3101, "z " * 20_000)]
    return rows


@pytest.mark.parametrize("small_bucket", [minhash_dedup.SMALL_BUCKET, 2])
def test_components_are_those_of_plain_sets(spark, small_bucket):
    rows = sample()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, key string").repartition(6)
    got = MinHashDedup(frame, small_bucket=small_bucket).documents()
    assert found(got) == plain(rows)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CHUNK", 7)
    rows = [r for r in sample() if r[0] is not None and r[0] < 2000]
    assert found(MinHashDedup(spark.createDataFrame(rows, "doc_id long, text string"), small_bucket=2).documents()) == plain(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    assert found(near_duplicates(alone)) == [(1, 2, 1, True), (2, 0, 2, True)]


def test_bounds_are_those_of_the_posterior():
    s = LINK[0] / LINK[1]
    grid = (np.arange(200_000) + 0.5) / 200_000
    for k, m in zip(range(BATCH, HASHES + 1, BATCH), least_matches(s, MISS)):
        def chance(matches, k=k):
            density = np.exp(matches * np.log(grid) + (k - matches) * np.log1p(-grid) - matches * np.log(s) - (k - matches) * np.log1p(-s))
            return density[grid >= s].sum() / density.sum()

        assert chance(m) >= MISS > chance(m - 1)
    assert (1 - s**ROWS) ** BANDS < 1e-6


def test_linked_pairs_survive_and_unlike_ones_leave_early():
    rng = np.random.default_rng(4)
    kept = {}
    for shared, each in ((920, 80), (600, 400)):  # similarity 0.852 and 0.43
        left, right = [], []
        for _ in range(150):
            values = rng.integers(0, 2**63, shared + 2 * each, dtype=np.uint64)
            sets = values[: shared + each], np.concatenate([values[:shared], values[shared + each :]])
            for side, one in zip((left, right), sets):
                side.append(np.frombuffer(minhash_dedup._signature(minima(one)), np.uint16))
        matches = np.mean(np.array(left) == np.array(right))
        assert abs(matches - shared / (shared + 2 * each)) < 0.01  # the signatures are not biased
        kept[shared] = len(survivors(np.array(left), np.array(right), 0.85, MISS))
    assert kept == {920: 150, 600: 0}
