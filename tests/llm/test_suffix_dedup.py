"""Repeated passages against plain code."""

import random

from talkmill.llm.suffix_dedup import PASSAGE, repeated_passages


def plain(rows):
    distinct = sorted({(i, t) for i, t in rows if t is not None}, key=str)
    split = [(i, t.lower().split()) for i, t in distinct]
    owners = {}
    for k, (_, w) in enumerate(split):
        for s in range(len(w) - PASSAGE + 1):
            owners.setdefault(tuple(w[s : s + PASSAGE]), set()).add(k)
    out = []
    for i, w in split:
        covered = [False] * (len(w) + 1)
        for s in range(len(w) - PASSAGE + 1):
            if len(owners[tuple(w[s : s + PASSAGE])]) > 1:
                covered[s : s + PASSAGE] = [True] * PASSAGE
        s = 0
        while s < len(w):
            e = s
            while covered[e]:
                e += 1
            if e > s:
                out.append((i, s, e - s))
            s = max(e, s + 1)
    return sorted(out, key=str)


def test_spans_are_those_of_a_plain_search(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    passages = [[word() for _ in range(rng.randint(45, 120))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            text += [word() for _ in range(rng.randint(0, 60))] + p[a : rng.randint(a, len(p))]
        rows.append((i, " ".join(text)))
    base = [word() for _ in range(300)]
    for i in range(30):  # near copies, edited here and there, with common parts to the left or right of any position
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = word()
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, "of " * 400), (201, "Of " * 120), (202, "of " * 49), (203, " ".join(base[:50])), (204, " ".join(base[:49]))]
    rows += [(300, " ".join(word() for _ in range(80)))] * 2 + [(None, " ".join(base)), (301, None), (302, "")]
    rows += [(5, rows[40][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(5)
    got = sorted(((r.doc_id, r.start_word, r.n_words) for r in repeated_passages(docs).collect()), key=str)
    assert got == plain(rows)
    assert all(n >= PASSAGE for _, _, n in got) and {i for i, *_ in got} >= {200, 201, 203, None} and 204 not in {i for i, *_ in got}


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
