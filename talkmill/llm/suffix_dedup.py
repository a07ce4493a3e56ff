"""Repeated passages by sparse suffix arrays.

Of all suffixes of all documents only those at minimiser positions are kept:
every window of ``PASSAGE`` words names the smallest hash among its runs of
``ANCHOR`` words, so equal windows name equal suffixes wherever they stand, and
about one word in sixteen begins a kept suffix. Suffixes are not sorted: those
with the same beginning are brought together by hashes of their words:

1. A suffix whose first ``ANCHOR`` words no other document has begins no shared
   passage, and goes.
2. Each remaining one is extended left and right over all windows that name it.
   If another document has the same extended stretch, all of it repeats.
3. The others, at the borders of what is shared, are compared window by window,
   also with one stretch of each kind found in step 2.

Windows that stand in two documents are joined to maximal spans. That is exact: a
span is a longest run of words that lie in windows of ``PASSAGE`` words which
some other document has too (A-Z in lower case; hashes of 64 bits). Comparing
only direct neighbours in suffix order would miss passages whose common part lies
mostly to the left of the kept position, hence steps 2 and 3.

Each comparison is a sum per hash that is combined before the shuffle, so a passage
that a third of all documents share is one row per task; joins back to such a
passage are skewed sides, which adaptive execution splits. Shuffled are a few
numbers per kept suffix, and texts only of documents with a border to compare.

Defined results: null texts and texts with fewer than ``PASSAGE`` words have no
span; rows with equal doc_id and text are one document and one set of spans; rows
with equal doc_id and other text are different documents; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import take_columns
from talkmill.llm.shingles import mix, word_hashes
from talkmill.operators.joins import broadcast_if
from talkmill.session import cut_lineage, scratch_path, ship_package

PASSAGE = 50
ANCHOR = 20
ROW_BYTES = 48

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Runs:
    """Hashes of any run of words of one text."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(_INVERSE, n), dtype=np.uint64, out=self.sums[1:])
        self.scale = _powers(_BASE, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.scale[starts] + lengths)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Runs]:
    """Of each kept suffix the windows that name it (first and last start), the hash of its first words."""
    runs = _Runs(words)
    starts = np.arange(len(words) - ANCHOR + 1)
    named = _least(runs.hashes(starts, starts + ANCHOR), PASSAGE - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(named) - 1]])
    return first, last, named[first], runs


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to the beginnings of kept suffixes with the smallest and largest document of the batch that has each."""
    for batch in batches:
        found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = word_hashes(text)
            if len(words) >= PASSAGE:
                anchors = np.unique(stretches(words)[2])
                found.append(anchors)
                owners.append(np.full(len(anchors), row, np.int64))
        anchor, owner = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)])
        end = np.concatenate([begin[1:], [len(anchor)]]).astype(np.int64)[: len(begin)] - 1
        yield pa.RecordBatch.from_arrays(
            [_signed(anchor[begin]), pa.array(owner[begin]), pa.array(owner[end])], names=["anchor", "lo", "hi"]
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (anchor, row, first, last, stretch) of every kept suffix."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = word_hashes(text)
            if len(words) < PASSAGE:
                continue
            first, last, anchor, runs = stretches(words)
            stretch = runs.hashes(first, last + PASSAGE)
            row_of = np.full(len(first), row, np.int64)
            for column, values in zip(columns, (anchor.view(np.int64), row_of, first, last, stretch.view(np.int64))):
                column.append(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(column)) for column in columns], names=["anchor", "row", "first", "last", "stretch"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, stretches to compare) to (window, lo, hi, row, start) of all their windows."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs = _Runs(word_hashes(text))
            for part in wanted:
                starts = np.arange(part["first"], part["last"] + 1)
                window = runs.hashes(starts, starts + PASSAGE).view(np.int64)
                fixed = [np.full(len(starts), part[name], np.int64) for name in ("lo", "hi", "row")]
                for column, values in zip(columns, (window, *fixed, starts)):
                    column.append(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(column)) for column in columns], names=["window", "lo", "hi", "row", "start"]
        )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, starts, ends) of covered stretches to maximal spans (doc_id, start_word, n_words)."""
    for batch in batches:
        ids, begins, sizes = [], [], []
        for doc_id, start, end in zip(*(column.to_pylist() for column in batch.columns)):
            start, end = np.array(start), np.array(end)
            order = np.lexsort((end, start))
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            stop = reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]
            ids.extend([doc_id] * len(new))
            begins.extend(start[new].tolist())
            sizes.extend((stop - start[new]).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.column(0).type), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())],
            names=["doc_id", "start_word", "n_words"],
        )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words): the spans of every document (doc_id, text) that other documents share."""
    spark = docs.sparkSession
    ship_package(spark)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"passages-{name}")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    texts = take_columns(docs, doc_id="doc_id", text="text").where("text is not null")
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    shared = F.min("lo") < F.max("hi")

    anchors = texts.select("row", "text").mapInArrow(_anchors, "anchor long, lo long, hi long")
    common = kept(anchors.groupBy("anchor").agg(shared.alias("shared")).where("shared").select("anchor"), "anchors")
    common = broadcast_if(common, ROW_BYTES * common.count())
    segments = texts.select("row", "text").mapInArrow(
        _segments, "anchor long, row long, first long, last long, stretch long"
    )
    # rows that are equal in id and text are one document
    segments = kept(segments.join(common, "anchor"), "segments")

    alike = segments.groupBy("anchor", "stretch").agg(
        F.min("row").alias("lo"), F.max("row").alias("hi"), F.min_by(F.struct("first", "last"), "row").alias("at")
    )
    alike = kept(alike, "stretches")
    whole = segments.join(alike.where("lo < hi").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
    # borders, and one stretch of each kind that meets one
    alone = alike.where("lo = hi")
    open_anchors = alone.select("anchor").distinct()
    singles = segments.join(alone.select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
    examples = alike.where("lo < hi").join(open_anchors, "anchor", "left_semi")
    wanted = singles.select("row", "first", "last", F.col("row").alias("lo"), F.col("row").alias("hi")).union(
        examples.select(F.col("lo").alias("row"), "at.first", "at.last", "lo", "hi")
    )
    wanted = wanted.distinct().groupBy(F.col("row").alias("wanted_row")).agg(
        F.collect_list(F.struct("first", "last", "lo", "hi", "row")).alias("wanted")
    )
    wanted = kept(wanted, "wanted")
    size = wanted.agg(F.coalesce(F.sum(ROW_BYTES + 40 * F.size("wanted")), F.lit(0))).first()[0]
    met = texts.join(broadcast_if(wanted, size), F.col("row") == F.col("wanted_row")).select("text", "wanted")
    windows = kept(met.mapInArrow(_windows, "window long, lo long, hi long, row long, start long"), "windows")
    repeated = windows.groupBy("window").agg(shared.alias("shared")).where("shared").select("window")
    single = windows.where("lo = hi").join(repeated, "window", "left_semi")

    covered = whole.select("row", F.col("first").alias("start"), (F.col("last") + PASSAGE).alias("end")).union(
        single.select("row", "start", (F.col("start") + PASSAGE).alias("end"))
    )
    # at most one stretch for each word of the document
    found = covered.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    marks = cut_lineage(found)
    ids = texts.select("row", "doc_id").distinct()
    return marks.join(ids, "row").select("doc_id", "covered.start", "covered.end").mapInArrow(
        _spans, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, start_word long, n_words long"
    )
