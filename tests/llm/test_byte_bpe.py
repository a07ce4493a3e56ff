"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from talkmill.llm.byte_bpe import ByteBpe, Codec, EncodedText, read_ranks
from talkmill.llm.catalog import op4_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return Codec(ranks, P.PATTERN)


def strings(tokens, count, seed):
    rng = random.Random(seed)
    for k in range(count):
        n = rng.randint(0, 25)
        if k % 3 == 0:
            yield "".join(chr(rng.choice([32, 10, 9, 28, 133, 160, 39, 115, 108, 97, 0x4E00, 0x1F600, 0x301, 48, 33])) for _ in range(n))
        elif k % 3 == 1:
            yield b"".join(rng.choice(tokens) for _ in range(n)).decode("utf8", "ignore")
        else:
            yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé àüß'") for _ in range(3 * n))


def test_ids_are_those_of_the_library(ranks, library, codec):
    for text in strings(list(ranks), 900, 1):
        ids = np.frombuffer(codec.text_bytes(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_appends_and_edits_are_exact(ranks, library, codec):
    rng = random.Random(7)
    for text in strings(list(ranks), 150, 2):
        edited = EncodedText(codec, text)
        for _ in range(4):
            start = rng.randint(0, len(edited.text))
            stop = min(len(edited.text), start + rng.randint(0, 4))
            new = "".join(rng.choice(" 'slreab\n1!é") for _ in range(rng.randint(0, 4)))
            if rng.random() < 0.4:
                edited.append(new)
            else:
                edited.replace(start, stop, new)
            assert edited.ids() == library.encode_ordinary(edited.text)


def test_long_pieces(library, codec):
    text = "a" * 20_000 + "é" * 2_000 + " " * 20_000 + "!"
    assert np.frombuffer(codec.text_bytes(text), "<u4").tolist() == library.encode_ordinary(text)


def test_query(spark, data, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op4_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(spark):
    bpe = ByteBpe(spark, PATH, P.PATTERN)
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "x y", 5), (2, "x y", 5)], "doc_id int, text string, ids int")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in got) == [
        ("1", 0, b""), ("2", 2, b"x y"), ("2", 2, b"x y"), ("None", 0, b"")
    ]
    assert bpe.encode(docs.limit(0)).count() == 0
