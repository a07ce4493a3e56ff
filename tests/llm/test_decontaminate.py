"""SimHash search: the multi-index against a linear scan, exact similarity, planted passages."""

import random
from collections import Counter

import numpy as np
import pytest

from talkmill.llm import decontaminate as d
from talkmill.llm.catalog import op7_decontaminate
from talkmill.llm.shingles import window_hashes


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**64, 30, np.uint64)
    prints = rng.integers(0, 2**64, 300, np.uint64)
    for k in range(200):  # some near ones
        flips = rng.choice(64, rng.integers(0, 16), replace=False)
        prints[k] = items[k % 30] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else items[k % 30]
    rows, entries = d._Tables(items, d.RADIUS).search(prints)
    near = np.bitwise_count(prints[:, None] ^ items[None, :]) <= d.RADIUS
    assert sorted(zip(rows.tolist(), entries.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_fingerprints_are_majorities_of_bits():
    pairs = np.random.default_rng(3).integers(0, 2**64, 40, np.uint64)
    got = d.fingerprints(pairs, 9)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    for k, value in enumerate(got):
        assert np.array_equal(np.unpackbits(np.array([value]).view(np.uint8)), bits[k : k + 8].sum(axis=0) > 4)


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.randint(12, 60)))) for k in range(60)] + [(60, "too short"), (61, None), (62, "")]
    docs, wanted = [], set()
    for i in range(300):
        text = words(rng, rng.randint(0, 200))
        if i % 3 == 0:
            item = items[i % 60][1].split()
            if i % 2:  # a near copy: the first word differs
                item[0] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() if i % 4 == 0 else w + "," for w in item]
            wanted.add((i, i % 60))
        docs.append((i, "\n".join(text)))
    return items, docs, wanted


def test_planted_passages_and_nothing_else(spark, planted):
    items, docs, wanted = planted
    rows = [(i, t, "x") for i, t in docs] + [(1000, None, "x"), (1001, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = d.find(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and len(found) == len(wanted)
    texts, by_id = dict(docs), dict(items)
    for r in found:
        window = d.text_words(texts[r.doc_id])[r.start_word : r.start_word + r.n_words]
        a, b = (Counter(window_hashes(x, 5).tolist()) for x in (window, d.text_words(by_id[r.item_id])))
        assert r.similarity == pytest.approx(sum((a & b).values()) / sum((a | b).values())) and r.similarity >= 0.75
    clean = {r.doc_id for r in d.clean(frame, benchmark).collect()}
    assert clean == {row[0] for row in rows} - {doc for doc, _ in wanted}
    assert d.find(frame.limit(0), benchmark).count() == d.find(frame, benchmark.limit(0)).count() == 0


def test_many_passes_give_the_same(spark, planted, monkeypatch):
    items, docs, wanted = planted
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(d, "ITEMS_PER_PASS", 20)
    assert {(r.doc_id, r.item_id) for r in d.find(frame, benchmark).collect()} == wanted


def test_query_finds_what_holds_most_of_an_item(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    sets = {r.item_id: set(window_hashes(d.text_words(r.text), 5).tolist()) for r in items}
    wanted = set()
    for r in docs:
        shingles = set(window_hashes(d.text_words(r.text), 5).tolist())
        wanted |= {(r.doc_id, k) for k, s in sets.items() if s and len(s & shingles) >= 0.9 * len(s)}
    assert {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, data).collect()} == wanted


def plain_matches(items, text, similarity=0.75):
    """Every item whose most similar window, of the item's size and cut at the ends, is similar enough, by a scan."""
    sets = [Counter(window_hashes(d.text_words(t), 5).tolist()) for _, t in items]
    holders = Counter(s for one in sets for s in one)
    weight = lambda s: 1 / max(holders[s], 1)
    words, out = d.text_words(text), {}
    for (item, body), theirs in zip(items, sets):
        size = len(d.text_words(body))
        for start in range(5 - size, len(words) - 4):
            window = words[max(start, 0) : start + size]
            mine = Counter(window_hashes(window, 5).tolist())
            both = sum(n * weight(s) for s, n in (mine & theirs).items())
            alike = round(both / sum(n * weight(s) for s, n in (mine | theirs).items()), 9)
            if alike >= similarity and alike > out.get(item, (0, 0, 0))[2]:
                out[item] = max(start, 0), len(window), alike
    return out


def edited(rng, item, where):
    """An item with about an eighth of its words replaced in one or two stretches, or cut off."""
    n, cut = len(item), max(1, (len(item) - 4) // 7 - 4)
    fresh = words(rng, n)
    if where == "middle":
        at = rng.randint(1, n - cut - 1)
        return item[:at] + fresh[:cut] + item[at + cut :]
    if where == "ends":
        return fresh[: n // 15] + item[n // 15 : n - n // 15] + fresh[n - n // 15 :]
    if where == "insert":
        return item[: n // 2] + fresh[: n // 12] + item[n // 2 :]
    return item[n // 6 :] if where == "head off" else item[: n - n // 6]


@pytest.mark.parametrize("where", ["middle", "ends", "insert", "head off", "tail off"])
def test_edited_items_are_those_of_a_plain_scan(where):
    rng = random.Random(where)
    phrase = words(rng, 12)
    items = []
    for k, n in enumerate([12, 20, 50, 50, 100, 100, 200, 260, 400]):
        body = words(rng, n)
        if k % 2:
            body[3 : 3 + min(len(phrase), n // 2)] = phrase[: n // 2]  # items share shingles
        items.append((k, " ".join(body)))
    texts = []
    for k, (_, body) in enumerate(items):
        around = 0 if where.endswith("off") else 30
        texts.append(" ".join(words(rng, around) + edited(rng, body.split(), where) + words(rng, 30 if where == "tail off" and k % 2 else around)))
    got = d.Searcher(items).search(texts)
    wanted = [plain_matches(items, text) for text in texts]
    assert sum(map(len, wanted)) >= 5
    for found, plain in zip(got, wanted):
        assert {row[0]: (row[1], row[2], pytest.approx(row[3])) for row in found} == plain


def test_passes_do_not_change_the_weights_of_shared_phrases(spark, monkeypatch):
    rng = random.Random(6)
    phrases = [words(rng, 14) for _ in range(4)]
    items = [(k, " ".join(words(rng, 15) + phrases[k % 4] + words(rng, 6))) for k in range(40)]
    docs = []
    for k, (_, body) in enumerate(items):
        body = body.split()
        body[k % 3 : k % 3 + 1 + k % 4] = words(rng, 1)
        docs.append((k, " ".join(words(rng, 5) + body + phrases[(k + 1) % 4])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one_pass = sorted(map(tuple, d.find(frame, benchmark).collect()))
    assert one_pass == sorted((k, *row) for k, found in enumerate(d.Searcher(items).search([t for _, t in docs])) for row in found)
    monkeypatch.setattr(d, "ITEMS_PER_PASS", 5)
    assert sorted(map(tuple, d.find(frame, benchmark).collect())) == one_pass and len(one_pass) > 10
    kept = {r.doc_id for r in d.clean(frame, benchmark).collect()}
    assert kept == {k for k, _ in docs} - {row[0] for row in one_pass}
