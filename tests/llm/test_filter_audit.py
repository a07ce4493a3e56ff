"""The filter audit against a plain run of every order, and the potential against the definition of Shapley values."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from talkmill.llm.filter_audit import audit, potential

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    ids = {}
    for i, text, _ in docs:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > ids[t],
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                removed_by[x] += len(gone)
                earlier = sum(x in r[1] for r in own) - len(gone)
                left = [r for r in left if x not in r[1]]
                only = sum(r[1] == {x} for r in own)
                steps.append((part, "".join(order), k, len(left), len(gone), earlier, only,
                              sum(r[2] for r in gone), sum(r[3] for r in gone), x))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ).collect())


def test_equals_a_run_of_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", " \x0b\t", "A", "word " * 99, "word " * 100, "Ab #" * 60, "é" * 9 + "A", "x" * 200_000 + " |"]
    texts += [" ".join(f"w{k}" for k in range(n)) + end for n in (79, 99, 100, 101) for end in ("", " %", " ABCDEFGH" * 20)]
    texts += [" ".join([f"w{k}" for k in range(80)] + ["again"] * n) for n in (19, 20, 21)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    docs += [docs[7]] * 40 + [(None, "word", "en"), (None, "word", "en"), (None, None, None), (500, "word", "en"), (-1, "word", "fr")]
    docs += [(9, "another text of one id", "en"), (9, "A", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", part string, mask int").repartition(4)
    marks = spark.createDataFrame([(*r, True) for r in labels], LABELS + ", good boolean")
    assert rows_of(audit(frame, marks)) == plain(docs, labels)


def test_no_labels_and_no_documents(spark):
    docs = [(1, "a", "en"), (2, "a", "en")]
    empty = spark.createDataFrame([], LABELS)
    assert rows_of(audit(spark.createDataFrame(docs, DOCS), empty)) == plain(docs, [])
    assert audit(spark.createDataFrame([], DOCS), empty).count() == 0


def test_potential_gives_shapley_values_of_any_game(spark):
    rng = random.Random(5)
    game = [0] + [rng.randint(0, 10**12) for _ in range(31)]
    p = spark.createDataFrame([(game,)], "v array<long>").select(potential(F.col("v"))).first()[0]
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += game[before | 1 << i] - game[before]
        assert p[31] - p[31 ^ 1 << i] == total
