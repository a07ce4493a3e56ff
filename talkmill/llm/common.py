"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also when ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def take_columns(rows: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that further columns cannot clash."""
    return rows.select(*[F.col(f"`{column}`").alias(name) for name, column in wanted.items()])


# Rows of an Arrow batch that are worked on at once, so that a worker holds little beside the batch.
PART_ROWS = 500


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


# Elements of an array that are folded at once: a fold copies what it has so far for every element.
CHUNK = 128


def running(values: Column, step: Callable[[Column, Column], Column], start: int) -> Column:
    """For each element of an array of whole numbers, the fold (``step``, from ``start``) of those before it.

    ``step`` is associative with ``start`` as its neutral element. Chunks are folded by themselves and then as wholes.
    """
    nothing = F.array().cast("array<int>")

    def fold(array: Column) -> Column:
        """The folds before each element, and the fold of all as the last one."""
        grown = lambda state, x: F.struct(
            step(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")
        )
        first = F.struct(F.lit(start).cast("int").alias("at"), nothing.alias("out"))
        return F.aggregate(array, first, grown, lambda state: F.concat(state["out"], F.array(state["at"])))

    def whole(array: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int"))
        chunks = F.transform(places, lambda k: fold(F.slice(array, k * CHUNK + 1, F.lit(CHUNK))))
        return let(chunks, lambda done: joined(done, fold(F.transform(done, lambda c: F.element_at(c, -1)))))

    def joined(done: Column, before: Column) -> Column:
        moved = lambda c, b: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: step(b, x))
        return F.flatten(F.zip_with(done, F.slice(before, 1, F.size(done)), moved))

    return let(values, lambda array: F.when(F.size(array) == 0, nothing).otherwise(whole(array)))
