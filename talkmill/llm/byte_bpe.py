"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text one token is stored: the last token of that
prefix's encoding. It is unique, because an encoding is right exactly when each
token stands for its own bytes and each two neighbours stay as they are when
their joined bytes are merged. So the last token of a prefix is found among the
tokens that end there, as the one that goes with the stored last token of what
is before it. Appending bytes only appends to the table, and an edit recomputes
it from the edited byte on.

Texts are encoded in Arrow batches inside the tasks that read them; nothing is
shuffled. The rank file is read by the driver and broadcast (its size does not
grow with the data). A worker keeps the ids of pieces it has met, at most
``KEPT_PIECES`` of them; other pieces are encoded again.

Defined results: a null text is encoded as an empty one, to no ids; rows keep
their other columns out of the result but for the named key; equal rows each
give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import parts
from talkmill.session import ship_package, small_batches

KEPT_PIECES = 400_000
# White space as the pattern's own engine has it: \s of other engines holds more characters.
_SPACE_CLASSES = ((r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}"))


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """One vocabulary with its splitting pattern, and what has been learnt about its tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        for known, exact in _SPACE_CLASSES:
            pattern = pattern.replace(known, exact)
        self.split = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self._stays: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the lowest rank first. For a token's or two tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1)
            )
            if rank == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def stays(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if token not in self._stays:
            self._stays[token] = self.merge(self.bytes_of[token]) == [token]
        return self._stays[token]

    def goes_with(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes gives these two tokens."""
        key = left << 32 | right  # smaller than a tuple
        known = self._pairs.get(key)
        if known is None:
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._pairs) < 4 * KEPT_PIECES:
                self._pairs[key] = known
        return known

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one match of the pattern."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        prefixes = Prefixes(self)
        prefixes.append(data)
        return prefixes.ids()

    def text_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        kept, out = self._pieces, []
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = np.array(self.piece_ids(piece), "<u4").tobytes()
                if len(kept) < KEPT_PIECES:
                    kept[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.data = b""
        self.last: list[int] = []

    def append(self, data: bytes) -> None:
        """Encode further bytes; what is there already stays, except that the last tokens of new prefixes may reach back."""
        codec, last, old = self.codec, self.last, len(self.data)
        self.data += data
        # a token that ends in the new bytes begins at most its length before them
        begin = max(0, old - max(map(len, codec.ranks))) if old else 0
        done = old
        pairs, goes_with, stays = codec._pairs, codec.goes_with, codec.stays
        for end, (size, token) in codec.ends.iter(self.data[begin:].decode("latin-1")):
            end += begin + 1
            if end <= done:
                continue
            before = end - size
            if before:
                fits = pairs.get((last[before - 1], token))
                if fits is None:
                    fits = goes_with(last[before - 1], token)
                if not fits:
                    continue
            if stays(token):
                last.append(token)
                done = end

    def cut(self, size: int) -> None:
        """Forget what comes after the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size:]

    def ids(self) -> list[int]:
        found, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            found.append(token)
            at -= len(self.codec.bytes_of[token])
        return found[::-1]


class EncodedText:
    """An encoded text that can be appended to and edited."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.pieces: list[str] = []
        self.tables: list[Prefixes] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of ``text[start:stop]``; only pieces near the edit are split and encoded again."""
        old, ends, at = self.text, [], 0
        for piece in self.pieces:
            at += len(piece)
            ends.append(at)
        # a match depends on at most two characters after it, so a piece that ends earlier stays
        first = next((k for k, end in enumerate(ends) if end > start - 3), len(ends))
        at = ends[first - 1] if first else 0
        self.text = old[:start] + new + old[stop:]
        shift = len(self.text) - len(old)
        starts = {0 if k == 0 else ends[k - 1]: k for k in range(first, len(ends))}
        starts[len(old)] = len(ends)
        fresh: list[str] = []
        # pieces do not look back: once both texts begin a piece at the same place after the edit, the rest is the same
        while not (at - shift >= stop and at - shift in starts):
            piece = self.codec.match(self.text, at).group()
            fresh.append(piece)
            at += len(piece)
        last = starts[at - shift]
        tables = []
        for k, piece in enumerate(fresh):
            data = piece.encode()
            table = self.tables[first + k] if first + k < last else Prefixes(self.codec)
            same = next((i for i, (a, b) in enumerate(zip(table.data, data)) if a != b), min(len(table.data), len(data)))
            table.cut(same)
            table.append(data[same:])
            tables.append(table)
        self.pieces[first:last] = fresh
        self.tables[first:last] = tables

    def ids(self) -> list[int]:
        found: list[int] = []
        for table in self.tables:
            whole = self.codec.ranks.get(table.data)
            found.extend(table.ids() if whole is None else [whole])
        return found


_codecs: WeakKeyDictionary[Broadcast, dict[str, Codec]] = WeakKeyDictionary()


def _codec(ranks: Broadcast, pattern: str) -> Codec:
    """The worker's codec of a broadcast vocabulary, made once per worker; it goes when the worker, in another stage,
    drops the broadcast."""
    made = _codecs.setdefault(ranks, {})
    if pattern not in made:
        made[pattern] = Codec(ranks.value, pattern)
    return made[pattern]


class ByteBpe:
    """Encodes and decodes columns with one rank file and pattern."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        ship_package(spark)
        small_batches(spark)
        self.ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
        self.pattern = pattern

    def encode(self, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, ids array<int>) of every row."""
        ranks, pattern = self.ranks, self.pattern

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks, pattern)
            for batch in parts(batches):
                found = [np.frombuffer(codec.text_bytes(x), "<u4") for x in batch.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"]
                )

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(
            ids, f"`{key}` {kind}, ids array<int>"
        )

    def decode(self, rows: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
        """(key, n_tokens, id_bytes, decoded) of every row; the binary columns hold the ids as little-endian
        unsigned 32-bit integers and the bytes they stand for."""
        ranks, pattern = self.ranks, self.pattern

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(ranks, pattern)
            for batch in batches:
                column = batch.column(1)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                parts = [flat[end - size : end] for end, size in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array([part.astype("<u4").tobytes() for part in parts], pa.binary()),
                        pa.array([codec.decode(part) for part in parts], pa.binary()),
                    ],
                    names=[key, "n_tokens", "id_bytes", "decoded"],
                )

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, ids).mapInArrow(back, f"`{key}` {kind}, n_tokens long, id_bytes binary, decoded binary")
