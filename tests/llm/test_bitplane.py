"""Bit-plane files: planes, round trips, and the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from talkmill.llm import bitplane
from talkmill.llm.catalog import op5_bitplane

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_come_back(unit):
    rng = np.random.default_rng(1)
    for ids in ([0], [1, 2, 3], [2**32 - 1, 0], rng.integers(0, 49408, 70_001), rng.integers(0, 7, 9)):
        ids = np.array(ids, np.uint32)
        planes = bitplane.to_planes(ids, unit)
        assert np.array_equal(bitplane.from_planes(planes, len(ids), unit), ids)
    assert len(bitplane.to_planes(np.array([5, 300]), "byte")) == 2
    assert len(bitplane.to_planes(np.array([5, 300]), "bit")) == 9


def expected(tokenizer, rows):
    out, at = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = [tuple(r) for r in op5_bitplane(spark, data).orderBy("doc_id").collect()]
    assert got == expected(tokenizer, docs)


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_hostile_and_very_long_texts(spark, tmp_path, tokenizer, unit):
    rng = random.Random(3)
    parts = ["a", "É", "'s", " ", "\n", "\t", "\x0b", "\x1c", "\u0085", " ", "1", "!", "é", "́", "Σ", "😀", "<|endoftext|>"]
    texts = [None, "", " \n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts += [" ".join(rng.choice(["the", "house", "xqz", "1"]) for _ in range(150_000))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    bitplane.write(docs, f"{tmp_path}/x", PATH, 2, unit)
    got = bitplane.read(spark, f"{tmp_path}/x").orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.id_bytes))) for r in got] == expected(tokenizer, rows)


def test_equal_ids_nulls_and_empty_tables(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, "d e f")], "doc_id long, text string")
    bitplane.write(docs, f"{tmp_path}/x", PATH, 2)
    got = bitplane.read(spark, f"{tmp_path}/x").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and got[0].start == 0
    assert sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens == 11
    bitplane.write(docs.limit(0), f"{tmp_path}/y", PATH, 2)
    assert bitplane.read(spark, f"{tmp_path}/y").count() == 0


def test_other_tokenizers_get_whole_texts():
    import json

    with open(PATH) as source:
        parts = json.load(source)
    parts["normalizer"]["normalizers"] = parts["normalizer"]["normalizers"][:1]
    definition = json.dumps(parts)
    encoder, other = bitplane.WordEncoder(definition), Tokenizer.from_str(definition)
    assert not encoder.by_words
    for text in ("The House. a  b", "", "É\n1"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_the_given_tokenizer_is_read_by_words():
    with open(PATH) as source:
        assert bitplane.WordEncoder(source.read()).by_words


def test_groups_of_texts_equal_the_library(tokenizer, monkeypatch):
    rng = random.Random(5)
    letters = list("abyzABÉéßÿÀÞЖжйЙΣςİıǅãắ̈") + ["'s", "'", "’", "1", "²", "٣", "中", "😀", "\x01", "\x00"]
    signs = [".", ",", "!", "$$$", "&&", "<|", "|>", "</w>", "-", "_", "<|endoftext|>", "^`~"]
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " "]
    word = lambda: "".join(rng.choices(letters, k=rng.randint(0, 6))) + rng.choice(["", *signs]) + rng.choice(["", "", "a"])
    texts = ["", " ", *("".join(word() + rng.choice(blanks) for _ in range(rng.randint(0, 40))) for _ in range(400)), ""]
    with open(PATH) as source:
        definition = source.read()
    for size, kept in ((1 << 22, 600_000), (300, 50)):
        encoder = bitplane.WordEncoder(definition)
        monkeypatch.setattr(bitplane, "SLICE_BYTES", size)
        monkeypatch.setattr(bitplane, "KEPT_WORDS", kept)
        for rows in (pa.array(texts), pa.array(texts).slice(7, 200), pa.array(texts[:1]), pa.array([], pa.string())):
            wanted = [tokenizer.encode(text, add_special_tokens=False).ids for text in rows.to_pylist()]
            assert [ids.tolist() for ids in encoder.encode_all(rows)] == wanted


def test_common_words_need_only_the_model(tokenizer):
    with open(PATH) as source:
        encoder = bitplane.WordEncoder(source.read())
    encoder.tokenizer = None
    text = "The house, École naïve. Дом $$$ that&&& a"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_tokenizers_with_other_marks_get_whole_texts():
    import json

    with open(PATH) as source:
        parts = json.load(source)
    marked = parts | {"added_tokens": [*parts["added_tokens"], parts["added_tokens"][0] | {"id": 49408, "content": "house"}]}
    unmarked = parts | {"model": parts["model"] | {"end_of_word_suffix": None}}
    for changed in (marked, unmarked):
        assert not bitplane.splits_at_blanks(json.dumps(changed))
