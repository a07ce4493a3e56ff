"""Benchmark decontamination by SimHash windows and rare shingles.

A window matches an item if their weighted shingle similarity is at least
``SIMILARITY``: five-word shingles with their counts, each weighing one over the
number of items of the whole benchmark that have it, minima over maxima. Windows
have the item's number of words and are cut where they hang over an end of the text.

Candidates come from two searches. Each item is cut to a leading and a trailing
window of a size class (about three quarters of the item), and each window gets a
64-bit SimHash of its word pairs. Over every document windows of the same sizes
slide word by word. Fingerprints of a window and an item that differ in at most
``RADIUS`` bits differ in at most ``RADIUS // 4`` bits in one of four blocks of 16
bits, so a table of each block's values within that distance finds all of them.
Fingerprints alone miss matches whose changes lie close together. Therefore each
item also has anchors: its heaviest shingles, until they weigh more than one minus
``SIMILARITY`` of the item. A window without any of them cannot match, so documents
that hold an anchor are candidates, and no match is missed.

A candidate document is compared with the item at every place. The shared weight
only changes where a shared shingle enters or leaves the window, so it is a sum of
steps, and only stretches where it suffices are looked at closely.

Documents are searched where they are read; nothing of the corpus is shuffled or
collected. The benchmark is broadcast in passes of at most ``ITEMS_PER_PASS``
items, each one scan of the corpus. Shingles are counted over the whole benchmark
beforehand; those of more than one item are broadcast with every pass, 12 bytes each.

Words are runs of letters, digits and non-ASCII characters with A-Z in lower
case. Defined results: null or empty texts contain nothing; items with fewer than
five words are ordinary phrases and are not searched; equal items and equal rows
each count; an item that occurs often in a document is one row, the most similar
and first; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from talkmill.llm.common import take_columns
from talkmill.llm.shingles import window_hashes
from talkmill.session import ship_package, small_batches

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
# Window sizes in words; counts of up to 255 word pairs fit into a byte.
SIZES = (5, 8, 12, 18, 27, 40, 60, 90, 135, 200)
ITEMS_PER_PASS = 20_000
WORDS_AT_ONCE = 1 << 15

_TO_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MATCH = "item_id {item}, start_word long, n_words long, similarity double"


def text_words(text: str | None) -> np.ndarray:
    found = (text or "").encode().lower().translate(_TO_BLANK).split()
    return np.fromiter((xxh3_64_intdigest(word) for word in found), np.uint64, len(found))


def fingerprints(pairs: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` words, from the hashes of neighbouring word pairs."""
    width = size - 1
    if len(pairs) < width:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros((len(pairs) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=counts[1:])
    return _signs(counts, width)


def _signs(counts: np.ndarray, width: int) -> np.ndarray:
    ones = counts[width:] - counts[:-width]  # modulo 256
    return np.packbits(ones > width // 2, axis=1).view(np.uint64).ravel()


def _near(reach: int) -> np.ndarray:
    """All block values with at most ``reach`` bits."""
    return np.array(
        [sum(1 << bit for bit in bits) for k in range(reach + 1) for bits in combinations(range(BLOCK_BITS), k)],
        np.uint16,
    )


class _Tables:
    """The multi-index of the fingerprints of one window size."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        masks = _near(radius // BLOCKS)
        self.starts, self.entries = [], []
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            values = (block[:, None] ^ masks[None, :]).ravel()
            entries = np.repeat(np.arange(len(prints)), len(masks))
            order = np.argsort(values, kind="stable")
            self.entries.append(entries[order])
            self.starts.append(np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, entry) pairs within the radius."""
        rows, found = [], []
        for block, starts, entries in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, self.starts, self.entries):
            begin = starts[block]
            size = starts[block.astype(np.int64) + 1] - begin
            row = np.flatnonzero(size)
            size = size[row]
            first = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(begin[row] - first, size)
            row, entry = np.repeat(row, size), entries[at]
            near = np.bitwise_count(prints[row] ^ self.prints[entry]) <= self.radius
            rows.append(row[near])
            found.append(entry[near])
        pairs = np.unique(np.concatenate(rows) * len(self.prints) + np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Searcher:
    """The benchmark items of one pass, ready to be looked for."""

    def __init__(
        self, items: list[tuple], radius: int = RADIUS, similarity: float = SIMILARITY,
        shared: tuple[np.ndarray, np.ndarray] | None = None,
    ):
        """``shared``: the sorted shingles that more than one item of the benchmark has, and how many have each.

        Without it, ``items`` are taken as the whole benchmark.
        """
        self.similarity = similarity
        self.ids, self.sizes, self.shingles = [], [], []
        windows: dict[int, list[tuple[int, np.uint64]]] = defaultdict(list)
        holders: Counter[int] = Counter()
        for item_id, text in items:
            words = text_words(text)
            if len(words) < SHINGLE:
                continue
            shingles = Counter(window_hashes(words, SHINGLE).tolist())
            holders.update(shingles.keys())
            size = max(s for s in SIZES if s == SIZES[0] or 4 * s <= 3 * len(words))
            prints = fingerprints(window_hashes(words, 2), size)
            for offset in {0, len(words) - size}:
                windows[size].append((len(self.ids), prints[offset]))
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.shingles.append(shingles)
        if shared is None:
            often = sorted(shingle for shingle, count in holders.items() if count > 1)
            shared = np.array(often, np.uint64), np.array([holders[shingle] for shingle in often], np.int64)
        self.shared = shared
        self.tables = {
            size: (_Tables(np.array([w[1] for w in found], np.uint64), radius), np.array([w[0] for w in found]))
            for size, found in windows.items()
        }
        # every item's shingles as places in ``known``, their counts and weights
        self.known = np.array(sorted(holders), np.uint64)
        self.weight = self._weights(self.known)
        self.members, self.masses = [], []
        anchors: list[tuple[int, int]] = []
        for item, shingles in enumerate(self.shingles):
            place = np.searchsorted(self.known, np.array(sorted(shingles), np.uint64))
            count = np.array([n for _, n in sorted(shingles.items())], np.int64)
            mass = count * self.weight[place]
            self.members.append((place, count))
            self.masses.append(mass.sum())
            order = np.lexsort((place, -mass))
            enough = np.searchsorted(np.cumsum(mass[order]), (1 - similarity) * mass.sum() + 1e-9, side="right") + 1
            anchors.extend((int(p), item) for p in place[order[:enough]])
        anchors.sort()
        self.anchor_items = np.array([item for _, item in anchors], np.int64)
        self.anchor_starts = np.searchsorted(np.array([p for p, _ in anchors], np.int64), np.arange(len(self.known) + 1))

    def _weights(self, shingles: np.ndarray) -> np.ndarray:
        """One over the number of items that have a shingle; 1 if none has it."""
        keys, counts = self.shared
        out = np.ones(len(shingles))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
            hit = keys[at] == shingles
            out[hit] = 1 / counts[at[hit]]
        return out

    def _alike(self, window: np.ndarray, item: int) -> float:
        """Weighted minima over weighted maxima of the shingle counts."""
        mine, theirs = Counter(window.tolist()), self.shingles[item]
        names = np.array(sorted(mine.keys() | theirs.keys()), np.uint64)
        weights = self._weights(names)
        pairs = np.array([(mine[s], theirs[s]) for s in names.tolist()])
        return round(float(pairs.min(axis=1) @ weights) / float(pairs.max(axis=1) @ weights), 12)

    def _best(self, shingles: np.ndarray, total: np.ndarray, known: tuple[np.ndarray, np.ndarray], item: int) -> tuple | None:
        """The first of the most similar windows of one document: (start_word, n_words, similarity).

        ``total``: the summed weights before each shingle; ``known``: the places in ``self.known`` of the document's
        shingles, sorted, and where they stand.
        """
        names, at = known
        place, count = self.members[item]
        low, high = np.searchsorted(names, place, side="left"), np.searchsorted(names, place, side="right")
        needed = self.similarity * self.masses[item] - 1e-9
        weight = self.weight[place]
        if np.minimum(high - low, count) @ weight < needed:
            return None
        width = self.sizes[item] - SHINGLE + 1
        # an occurrence adds to windows that begin after the count-th one before it, so that minima are summed
        sizes = high - low
        owner = np.repeat(np.arange(len(place)), sizes)
        index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = low[owner] + index
        end = at[row]
        begin = end - width + 1
        later = index >= count[owner]
        begin[later] = np.maximum(begin[later], at[row[later] - count[owner[later]]] + 1)
        gains = begin <= end
        begin, end, step = begin[gains], end[gains], weight[owner[gains]]
        turns, inverse = np.unique(np.concatenate([begin, end + 1]), return_inverse=True)
        both = np.cumsum(np.bincount(inverse, np.concatenate([step, -step])))
        best = None
        for k in np.flatnonzero(both >= needed):
            starts = np.arange(turns[k], turns[k + 1])
            mine = total[np.minimum(starts + width, len(shingles))] - total[np.maximum(starts, 0)]
            first = int(np.argmin(np.round(mine, 9)))
            alike = round(both[k] / (self.masses[item] + mine[first] - both[k]), 9)
            if best is None or alike > best[0]:
                best = alike, int(starts[first])
        if best is None or best[0] < self.similarity - 1e-6:
            return None
        start, stop = max(best[1], 0), min(best[1] + self.sizes[item], len(shingles) + SHINGLE - 1)
        alike = self._alike(shingles[start : stop - SHINGLE + 1], item)
        return (start, stop - start, alike) if alike >= self.similarity else None

    def search(self, texts: Iterable[str | None]) -> list[list[tuple]]:
        """For each text its matches (item_id, start_word, n_words, similarity), one per item."""
        out: list[list[tuple]] = []
        group: list[np.ndarray] = []
        waiting = 0
        for text in texts:
            group.append(text_words(text))
            waiting += len(group[-1])
            if waiting >= WORDS_AT_ONCE:
                out.extend(self._search_words(group))
                group, waiting = [], 0
        out.extend(self._search_words(group))
        return out

    def _search_words(self, group: list[np.ndarray]) -> list[list[tuple]]:
        lengths = np.array([len(words) for words in group], np.int64)
        ends = np.cumsum(lengths)
        words = np.concatenate([*group, np.zeros(0, np.uint64)])
        best: list[dict[int, tuple]] = [{} for _ in group]
        if not self.tables or len(words) < 2:
            return [[] for _ in group]
        pairs = window_hashes(words, 2)
        counts = np.zeros((len(pairs) + 1, 64), np.uint8)
        np.cumsum(np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8, out=counts[1:])
        shingles = window_hashes(words, SHINGLE)
        end_of = np.repeat(ends, lengths)
        near: set[tuple[int, int]] = set()
        for size, (tables, items) in self.tables.items():
            if len(words) < size:
                continue
            inside = np.flatnonzero(np.arange(len(words) - size + 1) + size <= end_of[: len(words) - size + 1])
            row, entry = tables.search(_signs(counts, size - 1)[inside])
            docs = np.searchsorted(ends, inside[row], side="right")
            near.update(zip(docs.tolist(), items[entry].tolist()))
        if len(shingles):
            inside = np.arange(len(shingles)) + SHINGLE <= end_of[: len(shingles)]
            place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            hit = np.flatnonzero((self.known[place] == shingles) & inside)
            place = place[hit]
            size = self.anchor_starts[place + 1] - self.anchor_starts[place]
            entry = np.arange(size.sum()) + np.repeat(self.anchor_starts[place] - (np.cumsum(size) - size), size)
            docs = np.searchsorted(ends, np.repeat(hit, size), side="right")
            pairs = np.unique(docs * len(self.ids) + self.anchor_items[entry])
            near.update(zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist()))
            hit_starts = np.searchsorted(hit, np.concatenate([ends - lengths, ends[-1:]]))
        ready, last = None, -1
        for doc, item in sorted(near):
            first, stop = int(ends[doc] - lengths[doc]), int(ends[doc]) - SHINGLE + 1
            if stop <= first:
                continue
            if doc != last:
                own = slice(hit_starts[doc], hit_starts[doc + 1])
                order = np.argsort(place[own], kind="stable")
                mine = shingles[first:stop]
                total = np.concatenate([[0.0], np.cumsum(self._weights(mine))])
                ready, last = (mine, total, (place[own][order], hit[own][order] - first)), doc
            found = self._best(*ready, item)
            if found:
                best[doc][item] = found
        return [[(self.ids[item], *found) for item, found in sorted(matches.items())] for matches in best]


def _passes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in lists of bounded length."""
    items = take_columns(benchmark, item_id=item_id, text=text)
    passes = max(1, -(-items.count() // ITEMS_PER_PASS))
    for k in range(passes):
        yield [tuple(row) for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]


def _shared(benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles that more than one item has, and how many have each."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(window_hashes(text_words(text), SHINGLE)) for text in batch.column(0).to_pylist()]
            every = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64())], names=["shingle"])

    each = take_columns(benchmark, text="text").mapInArrow(distinct, "shingle long")
    often = each.groupBy("shingle").count().where("count > 1").toArrow()
    keys, counts = often["shingle"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.uint32)


def find(docs: DataFrame, benchmark: DataFrame, *, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): every document's benchmark items and where they stand.

    ``docs``: doc_id, text; ``benchmark``: item_id, text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    rows = take_columns(docs, doc_id="doc_id", text="text")
    kinds = {name: frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (benchmark, "item_id"))}
    schema = f"doc_id {kinds['doc_id']}, {MATCH.format(item=kinds['item_id'])}"
    found = None
    often = spark.sparkContext.broadcast(_shared(benchmark))
    for items in _passes(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast((items, radius, similarity))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value, often.value)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                hits = searcher.search(text.as_py() for text in batch.column(1))
                rows = [(key, *hit) for key, matches in zip(keys, hits) for hit in matches]
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = [batch.column(0).type, None, pa.int64(), pa.int64(), pa.float64()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                        names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns; each row is judged where it is read."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    often = spark.sparkContext.broadcast(_shared(benchmark))
    for items in _passes(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast((items, RADIUS, SIMILARITY))
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value, often.value)
            for batch in batches:
                hits = searcher.search(text.as_py() for text in batch.column(at))
                yield batch.filter(pa.array([not matches for matches in hits], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
