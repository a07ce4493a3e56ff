"""Token ids in bit-plane files.

Documents are put into ascending doc_id order over range partitions, encoded, and
their ids run on through blocks of ``BLOCK_IDS``. Each block is transposed, so that
the first bytes (or bits) of all its ids stand together, then the second ones, and
every such plane is compressed with zstandard by itself: high planes hardly
change and shrink to little.

A file set is a folder of Parquet files without further compression, one row per
block: shard, block, first (ids of the shard before it), n_ids, unit (byte or
bit), planes, and the index of the document pieces in the block: doc_id, place of
the document in its shard, ids of it before the piece, ids in the piece, ids of
the whole document. Reading only the index reads no planes. Spark's writer puts
the files where any executor can read them, and a lost task writes its blocks
again.

The only shuffle is the one that sorts: texts travel once, and blocks are read back
without one, except that documents which cross a block's end are put together by
their place. Equal doc_ids are ordered, and dealt over partitions, by a hash of
their text, so that one frequent id does not fill one partition.

Defined results: a null text counts as empty, and an empty one is only the end id;
a null doc_id comes first; equal rows each are a document; an empty table gives
an empty file set.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.llm.common import take_columns
from talkmill.session import ship_package

BLOCK_IDS = 1 << 16
LEVEL = 3
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
# No more words are kept once there are so many.
KEPT_WORDS = 600_000
_BETWEEN = "\x01"
# Bytes of text that are split into words at once, texts at most, and runs that are encoded at once.
SLICE_BYTES = 1 << 22
GROUP_TEXTS = 10_000
GROUP_RUNS = 20_000
# Letters that are whole by themselves and become one other letter in lower case, and signs that begin no contraction.
_PLAIN = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿА-я]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"
# The pattern of a tokenizer whose words can be kept.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """The compressed planes of a block of ids, lowest first; as many as its largest id needs."""
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    matrix = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "bit":
        matrix = np.unpackbits(matrix, axis=1, bitorder="little")
    planes = matrix.T[: max(1, int(np.flatnonzero(matrix.any(axis=0))[-1]) + 1 if matrix.any() else 1)]
    if unit == "bit":
        planes = np.packbits(planes, axis=1, bitorder="little")
    return [compressor.compress(np.ascontiguousarray(plane).tobytes()) for plane in planes]


def from_planes(planes: list[bytes], count: int, unit: str = "byte") -> np.ndarray:
    """The ids of a block."""
    decompressor = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(decompressor.decompress(plane), np.uint8) for plane in planes]
    if unit == "bit":
        rows = [np.unpackbits(row, bitorder="little")[:count] for row in rows]
    matrix = np.zeros((count, 32 if unit == "bit" else 4), np.uint8)
    for k, row in enumerate(rows):
        matrix[:, k] = row
    if unit == "bit":
        matrix = np.packbits(matrix, axis=1, bitorder="little")
    return matrix.view("<u4").ravel()


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and never joins across white space, keeping the ids of words it
    has met. The distinct words of a group of texts are looked up once. Words of common letters with common signs behind
    them are cut into these two runs here, and the runs are encoded by the tokenizer's model alone. Any other tokenizer
    (``by_words`` is false) is given whole texts."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.kept: dict[str, bytes] = {"": b""}
        self.by_words = splits_at_blanks(definition) and len(self._ids(_BETWEEN)) == 1
        if self.by_words:
            (self.between,) = self._ids(_BETWEEN).tolist()  # one id, which only texts with the character can have
            self.runs, self.ends = _of_runs(definition)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        data, out, at = text.encode(), [], 0
        if not self.by_words:
            return self._ids(text).tobytes()
        if b"<|" not in data:  # special tokens are found before letters are changed
            data = data.lower()
        while at < len(data):
            stop = at + SLICE_BYTES
            if stop < len(data):
                # slices end at a blank, so that no word is cut
                blank = _BLANK.search(data, stop)
                stop = blank.start() if blank else len(data)
            out.append(self._encode_words(pa.array([data[at:stop].decode()]))[0].tobytes())
            at = stop
        return b"".join(out)

    def encode_all(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text, none of which is null."""
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        while begin < len(texts):
            size = max(1, int(np.searchsorted(np.cumsum(lengths[begin : begin + GROUP_TEXTS]), SLICE_BYTES, side="right")))
            group = texts.slice(begin, size)
            if not self.by_words or lengths[begin] > SLICE_BYTES:
                yield from (np.frombuffer(self.encode(text), "<u4") for text in group.to_pylist())
            else:
                special = pc.match_substring(group, "<|")
                ids, ends = self._encode_words(pc.if_else(special, group, pc.ascii_lower(group)))
                yield from np.split(ids, ends[:-1])
            begin += size

    def _encode_words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        lists = pc.ascii_split_whitespace(texts)  # blanks at a text's ends give empty words
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid()
        odd = set(words.filter(pc.invert(plain)).to_pylist())
        letters = pc.if_else(plain, pc.utf8_lower(cut.field("letters")), words).dictionary_encode()
        signs = pc.if_else(plain, cut.field("signs"), "").dictionary_encode()
        runs = self._look_up(letters.dictionary, odd) + self._look_up(signs.dictionary, set())
        # a word's letters and signs, then each text's words
        pairs = np.stack([_codes(letters), _codes(signs) + len(letters.dictionary)], axis=1).ravel()
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        ids, counts = _gathered(np.frombuffer(b"".join(runs), "<u4"), sizes, pairs)
        ids, counts = _gathered(ids, counts.reshape(-1, 2).sum(axis=1), _codes(coded))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]

    def _look_up(self, words: pa.StringArray, odd: set[str]) -> list[bytes]:
        """The ids of distinct runs, and of words that are none (``odd``)."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.kept.get, words))
        new = [word for word, known in zip(words, ids) if known is None]
        if not new:
            return ids
        found = self._encode_runs([word for word in new if word not in odd])
        found |= self._encode_each([word for word in new if word in odd])
        if len(self.kept) < KEPT_WORDS:
            self.kept |= found
        return [found[word] if known is None else known for word, known in zip(words, ids)]

    def _encode_runs(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs that the tokenizer would not cut."""
        found = {}
        for at in range(0, len(runs), GROUP_RUNS):
            part = runs[at : at + GROUP_RUNS]
            (encoding,) = self.runs.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            found |= zip(part, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True)
        return found

    def _encode_each(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word: all are encoded as one text, with a control character between them."""
        odd = [word for word in words if _BETWEEN in word]
        plain = [word for word in words if _BETWEEN not in word]
        found = {word: self._ids(word).tobytes() for word in odd}
        if plain:
            ids = self._ids(f" {_BETWEEN} ".join(plain))
            cuts = (4 * np.flatnonzero(ids == self.between)).tolist()
            data = ids.tobytes()
            found |= zip(plain, (data[a:b] for a, b in zip([0, *(cut + 4 for cut in cuts)], [*cuts, len(data)])))
        return found

    def _ids(self, text: str) -> np.ndarray:
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, "<u4")


def _codes(coded: pa.DictionaryArray) -> np.ndarray:
    return coded.indices.to_numpy(zero_copy_only=False)


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces that ``codes`` name, one piece behind the other, and their sizes; piece k is the k-th of ``sizes`` ids."""
    counts = sizes[codes]
    places = np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(counts) - counts), counts)
    places += np.arange(len(places))
    return ids[places], counts


def _of_runs(definition: str):
    """A tokenizer of single runs: the model and the spelling of bytes; and for each id whether it ends a run."""
    from tokenizers import Tokenizer

    parts = json.loads(definition)
    spelling = parts["pre_tokenizer"]["pretokenizers"][1]
    parts |= {"normalizer": None, "pre_tokenizer": spelling, "post_processor": None, "added_tokens": []}
    model = parts["model"]
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[place for token, place in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
    return Tokenizer.from_str(json.dumps(parts)), ends


def splits_at_blanks(definition: str) -> bool:
    """Whether a tokenizers file lower-cases and cuts texts into runs of letters, single digits and runs of other signs,
    so that no token holds white space and signs behind letters begin a new run."""
    parts = json.loads(definition)
    normal, cut = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    kinds = [step["type"] for step in normal.get("normalizers", [])]
    steps = cut.get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and (normal["normalizers"][1]["pattern"], normal["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [step["type"] for step in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _RUNS}, "Removed", True)
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and all("<|" in token["content"] for token in parts.get("added_tokens") or [])
        and _ends_runs(parts["model"])
        and parts.get("truncation") is None
        and parts.get("padding") is None
    )


def _ends_runs(model: dict) -> bool:
    """Whether the last token of a run, and only that, is one with the suffix."""
    from tokenizers.pre_tokenizers import ByteLevel

    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or suffix != "</w>" or model.get("continuing_subword_prefix") or model.get("dropout"):
        return False
    return all(sign in model["vocab"] and sign + suffix in model["vocab"] for sign in ByteLevel.alphabet())


_encoders: dict[int, WordEncoder] = {}

_PIECES = "doc_ids array<{key}>, places array<long>, skipped array<long>, sizes array<int>, totals array<long>"
_SCHEMA = "shard int, block int, first long, n_ids int, unit string, planes array<binary>, " + _PIECES


class _Blocks:
    """Collects documents and hands out full blocks."""

    def __init__(self, shard: int, unit: str, key: pa.DataType):
        self.shard, self.unit, self.key = shard, unit, key
        self.block, self.first, self.place = 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.filled = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(ids):
            size = min(len(ids) - at, BLOCK_IDS - self.filled)
            self.ids.append(ids[at : at + size])
            self.pieces.append((doc_id, self.place, at, size, len(ids)))
            self.filled += size
            at += size
            if self.filled == BLOCK_IDS:
                yield self.flush()
        self.place += 1

    def flush(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        columns = list(zip(*self.pieces))
        kinds = [self.key, pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.shard], pa.int32()), pa.array([self.block], pa.int32()), pa.array([self.first], pa.int64()),
                pa.array([len(ids)], pa.int32()), pa.array([self.unit]),
                pa.array([to_planes(ids, self.unit)], pa.list_(pa.binary())),
                *[pa.array([list(column)], pa.list_(kind)) for column, kind in zip(columns, kinds)],
            ],
            names=[part.split()[0] for part in _SCHEMA.split(", ")],
        )
        self.block += 1
        self.first += len(ids)
        self.ids, self.pieces, self.filled = [], [], 0
        return batch


def write(docs: DataFrame, path: str, definition_path: str, end_id: int, unit: str = "byte") -> None:
    """Encode documents (doc_id, text) with a tokenizers file, append ``end_id`` to each, and write a file set."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(definition_path) as source:
        definition = spark.sparkContext.broadcast(source.read())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(definition.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = WordEncoder(definition.value)
        encoder, out = _encoders[key], None
        end = np.array([end_id], "<u4")
        for batch in batches:
            out = out or _Blocks(TaskContext.get().partitionId(), unit, batch.column(0).type)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                yield from out.add(doc_id, np.concatenate([ids, end]))
        if out and out.filled:
            yield out.flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = take_columns(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie")
    encoded = ordered.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    encoded.mapInArrow(blocks, _SCHEMA.format(key=kind)).write.option("compression", "none").parquet(path)


def _open(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Blocks to pieces with their ids: whole documents, or parts of documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            ids = from_planes(row["planes"], row["n_ids"], row["unit"])
            ends = np.cumsum(row["sizes"])
            starts = ends - row["sizes"]
            keep = np.flatnonzero((np.array(row["sizes"]) == np.array(row["totals"])) == whole)
            starts, ends = starts[keep], ends[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(ends), pa.int32()),
                    pa.array([row["doc_ids"][i] for i in keep], batch.schema.field("doc_ids").type.value_type),
                    pa.array([row["places"][i] for i in keep], pa.int64()),
                    pa.array(row["first"] + starts, pa.int64()),
                    pa.array([row["skipped"][i] for i in keep], pa.int64()),
                    pa.array([row["totals"][i] for i in keep], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["shard", "doc_id", "place", "at", "skipped", "n_tokens", "id_bytes"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, id_bytes) of every document of a file set.

    ``start`` counts the ids of all documents before it; ``id_bytes`` are its
    ids as little-endian unsigned 32-bit integers.
    """
    ship_package(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"shard int, doc_id {kind}, place long, at long, skipped long, n_tokens long, id_bytes binary"
    documents = blocks.mapInArrow(partial(_open, whole=True), schema)
    pieces = blocks.mapInArrow(partial(_open, whole=False), schema)
    # one row per shard
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    columns = ["shard", "doc_id", "at", "n_tokens", "id_bytes"]
    parts = F.sort_array(F.collect_list(F.struct("skipped", "id_bytes")))
    joined = (
        pieces.groupBy("shard", "place")
        .agg(
            F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.first("n_tokens").alias("n_tokens"),
            parts.alias("parts"),
        )
        .withColumn(
            "id_bytes", F.aggregate("parts", F.lit(b""), lambda total, part: F.concat(total, part["id_bytes"]))
        )
    )
    whole = documents.select(*columns).union(joined.select(*columns))
    return whole.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "id_bytes"
    )
