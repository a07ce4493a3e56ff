"""Cross-parsing against plain code, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from talkmill.llm import language_id
from talkmill.llm.catalog import op3_language_id


def plain_phrases(symbols, sample):
    """Greedy longest phrases that occur in the sample, or single symbols, anew in every block."""
    count, at = 0, 0
    while at < len(symbols):
        end = at
        while end < len(symbols) and (end // language_id.BLOCK == at // language_id.BLOCK):
            if symbols[at : end + 1] not in sample:
                break
            end += 1
        count += 1
        at = max(end, at + 1)
    return count


def test_phrases_are_those_of_a_plain_parse():
    rng = random.Random(4)
    texts = {k: ["".join(rng.choice(letters) for _ in range(400))] for k, letters in (("x", "abc  "), ("y", "abd "))}
    model = language_id.build(texts)
    samples = [bytes(model.encode(texts[name][0] + " ").tolist()) for name in model.languages]
    docs = ["", "a", "zzz", "z a1b"] + ["".join(rng.choice("abcdz ,") for _ in range(rng.randint(1, 1500))) for _ in range(60)]
    encoded = [model.encode(doc) for doc in docs]
    got = model.phrases(encoded)
    for symbols, counts in zip(encoded, got):
        for sample, count in zip(samples, counts):
            assert count == plain_phrases(bytes(symbols.tolist()), sample), symbols


def test_unknown_letters_and_texts_without_letters(spark):
    docs = spark.createDataFrame(
        [(1, "der die das und ist", "de"), (2, "the and is of to", "en"), (3, "12 .. 34", "en"), (4, None, "de"),
         (5, "", None), (6, "жжж", None), (None, "the of", None)],
        "doc_id int, text string, lang string",
    )
    model = language_id.train(docs)
    assert sorted(model.languages) == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[1].lang_pred == "de" and got[2].lang_pred == got[None].lang_pred == "en"
    assert [got[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0
    assert got[6].lang_pred in ("de", "en")
    nothing = language_id.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark, data):
    langs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = op3_language_id(spark, data).join(langs, "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")
    ).first()
    assert got[0] > 0.95 and got[1] >= 0 and got[2] <= 1


def test_long_texts_take_many_blocks():
    model = language_id.build({"x": ["ab" * 50], "y": ["cd" * 50]})
    counts = model.phrases([model.encode("ab" * 200_000)])[0]
    assert counts.argmin() == model.languages.index("x") and np.all(counts > 0)


def test_languages_of_other_scripts_keep_their_letters():
    rng = random.Random(5)
    scripts = {"la": (97, 26), "el": (0x3B1, 17), "ru": (0x430, 32), "uk": (0x450, 16), "th": (0xE01, 40), "ka": (0x10D0, 33),
               "zh": (0x4E00, 900), "ja": (0x6000, 900)}
    make = lambda at, n, size: "".join(" " if rng.random() < 0.1 else chr(at + min(int(rng.expovariate(4 / n)), n - 1)) for _ in range(size))
    # latin text is the most, so its letters are the most frequent
    texts = {name: [make(*span, 6000 if name == "la" else 2500)] for name, span in scripts.items()}
    model = language_id.build(texts)
    docs = {name: make(*span, 700) for name, span in scripts.items()}
    encoded = [model.encode(doc) for doc in docs.values()]
    got = model.phrases(encoded)
    assert [model.languages[k] for k in got.argmin(axis=1)] == list(docs)
    for k, name in enumerate(model.languages):
        own = model.own_symbols(k)
        sample = "".join(map(chr, own[model.encode(texts[name][0] + " ")]))
        for symbols, counts in zip(encoded, got):
            assert counts[k] == plain_phrases("".join(map(chr, own[symbols])), sample)


def test_every_label_is_learnt_and_tables_may_be_made_anew(spark, monkeypatch):
    rng = random.Random(3)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8)] for k in range(70)}
    text = lambda name: " ".join(rng.choice(words[name]) for _ in range(40))
    rows = [(n, text(name), name) for n, name in enumerate(sorted(words) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 70"))
    assert len(model.languages) == 70
    encoded = [model.encode(row[1]) for row in rows]
    counts = model.phrases(encoded)
    assert [model.languages[k] for k in counts.argmin(axis=1)] == [row[2] for row in rows]
    monkeypatch.setattr(language_id, "TABLE_BYTES", 0)
    assert (language_id.Model(model.known).phrases(encoded) == counts).all()
