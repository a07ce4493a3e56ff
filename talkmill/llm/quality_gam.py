"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins, and the model is one lookup table per
feature plus one per chosen pair of features. The tables are learnt by cyclic
boosting: round after round each feature in turn gets a small step of a tree
with at most three leaves, fitted to what the sum of all tables leaves over;
pairs follow, with trees of one cut per feature and side. A score is the
logistic of the sum of the tables' entries, so scoring is bin look-ups and
additions over whole Arrow batches.

The features are computed from whole texts inside the tasks that read them;
neither training nor scoring shuffles a text. The model is fitted on the driver
on the features of at most ``TRAINING_ROWS`` labelled documents (those with the
smallest hash of their id), which bounds its memory and time; it is a few
thousand numbers.

Defined results: a null text counts as empty and gets a score like any other;
labels that are null or whose document is missing teach nothing, and several
labels of one document count as their mean; without any label every score is
0.5; equal rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import parts, take_columns
from talkmill.session import ship_package, small_batches

TRAINING_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
MAIN_ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.1
RIDGE = 1.0

FEATURES = (
    "log_words", "word_length", "symbols", "exclamations", "stops", "digits", "capitals", "non_ascii",
    "distinct_words", "top_word", "repeated_windows", "copied_lines", "line_words", "longest_word",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)


def features(text: str) -> list[float]:
    """The feature values of one whole text."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    found = text.split()
    n = max(1, len(found))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    windows = len(found) - 2
    distinct = Counter(found)
    return [
        float(np.log1p(len(found))),
        sum(map(len, found)) / n,
        counts[_SYMBOLS].sum() / n,
        counts[33] / n,
        counts[_STOPS].sum() / n,
        counts[48:58].sum() / size,
        counts[65:91].sum() / size,
        counts[128:].sum() / size,
        len(distinct) / n,
        max(distinct.values(), default=0) / n,
        1 - len(set(zip(found, found[1:], found[2:]))) / windows if windows > 0 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        n / max(1, len(lines)),
        float(np.log1p(max(map(len, distinct), default=0))),
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(text) for text in texts], float).reshape(len(texts), len(FEATURES))


def _cuts(gain: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: what it gains and the number of bins before it (0: none)."""
    left_gain, left_weight = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    total_gain, total_weight = gain.sum(), weight.sum()
    value = left_gain**2 / (left_weight + RIDGE) + (total_gain - left_gain) ** 2 / (total_weight - left_weight + RIDGE)
    value = value - total_gain**2 / (total_weight + RIDGE)
    if not len(value) or value.max() <= 1e-9:
        return 0.0, 0
    return float(value.max()), int(value.argmax()) + 1


def _step(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree with at most three leaves over one feature's bins."""
    bounds = [0, len(gain)]
    for _ in range(2):
        best = max(
            ((*_cuts(gain[a:b], weight[a:b]), a) for a, b in zip(bounds, bounds[1:])), key=lambda x: x[0]
        )
        if best[1]:
            bounds = sorted({*bounds, best[2] + best[1]})
    out = np.zeros(len(gain))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = gain[a:b].sum() / (weight[a:b].sum() + RIDGE)
    return out


def _pair_step(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree over two features' bins: one cut of the first, one of the second on either side."""

    def build(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        _, cut = _cuts(g.sum(axis=1), w.sum(axis=1))
        out, worth = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
            _, second = _cuts(g[rows].sum(axis=0), w[rows].sum(axis=0))
            for columns in (slice(0, second), slice(second, None)) if second else (slice(None),):
                total, mass = g[rows, columns].sum(), w[rows, columns].sum() + RIDGE
                out[rows, columns] = total / mass
                worth += total**2 / mass
        return worth, out

    one, other = build(gain, weight), build(gain.T, weight.T)
    return one[1] if one[0] >= other[0] else other[1].T


@dataclass
class Gam:
    """Bin edges, lookup tables and pair tables."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return cls()
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        model = cls(base=float(np.log(mean / (1 - mean))))
        spread = lambda column, bins: np.unique(np.quantile(column, np.arange(1, bins) / bins))
        model.edges = [spread(column, BINS) for column in x.T]
        model.pair_edges = [spread(column, PAIR_BINS) for column in x.T]
        model.tables = [np.zeros(len(edges) + 1) for edges in model.edges]
        bins = [np.searchsorted(edges, column, side="right") for edges, column in zip(model.edges, x.T)]
        total = np.full(len(y), model.base)

        def left(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

        for _ in range(MAIN_ROUNDS):
            for table, where in zip(model.tables, bins):
                step = RATE * _step(*left(where, len(table)))
                table += step
                total += step[where]
        coarse = [np.searchsorted(edges, column, side="right") for edges, column in zip(model.pair_edges, x.T)]
        cells = {pair: coarse[pair[0]] * PAIR_BINS + coarse[pair[1]] for pair in combinations(range(x.shape[1]), 2)}
        worth = {}
        for pair, where in cells.items():
            gain, weight = left(where, PAIR_BINS**2)
            worth[pair] = float((gain**2 / (weight + RIDGE)).sum())
        chosen = sorted(worth, key=worth.get, reverse=True)[:PAIRS]
        model.pairs = {pair: np.zeros((PAIR_BINS, PAIR_BINS)) for pair in chosen}
        for _ in range(PAIR_ROUNDS):
            for pair, table in model.pairs.items():
                gain, weight = left(cells[pair], PAIR_BINS**2)
                step = RATE * _pair_step(gain.reshape(table.shape), weight.reshape(table.shape))
                table += step
                total += step.ravel()[cells[pair]]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for edges, table, column in zip(self.edges, self.tables, x.T):
            total += table[np.searchsorted(edges, column, side="right")]
        for (a, b), table in self.pairs.items():
            at = [np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in (a, b)]
            total += table[at[0], at[1]]
        return 1 / (1 + np.exp(-total))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Gam:
    """Fit on at most ``rows`` labelled documents. ``docs``: doc_id, text; ``labels``: doc_id, quality."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    taught = (
        take_columns(labels, doc_id="doc_id", quality="quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # bounded by ``rows``
    texts = take_columns(docs, doc_id="doc_id", text="text").join(F.broadcast(taught), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = feature_matrix(["" if text is None else text for text in batch.column(0).to_pylist()])
            arrays = [*map(pa.array, x.T), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*FEATURES, "y", "doc_id"])

    kinds = ", ".join(f"{name} double" for name in (*FEATURES, "y"))
    key = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("text", "y", "doc_id").mapInArrow(measured, f"{kinds}, doc_id {key}")
    # repeated documents may give more rows than labels, so the bound is set again; a fixed order makes one model
    rows_found = np.array(
        [tuple(row)[:-1] for row in found.orderBy(F.xxhash64("doc_id"), *FEATURES).limit(rows).collect()], float
    ).reshape(-1, len(FEATURES) + 1)
    return Gam.fit(rows_found[:, :-1], rows_found[:, -1])


def score(docs: DataFrame, model: Gam, *keep: str) -> DataFrame:
    """The columns ``keep`` of every document and its score (0 to 1) as ``_score``."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    columns = list(dict.fromkeys((*keep, "text")))
    at = columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = feature_matrix(["" if text is None else text for text in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(shared.value.score(x))], names=[*keep, "_score"]
            )

    rows = docs.select(*[F.col(f"`{name}`") for name in columns])
    kinds = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(scored, f"{kinds}, _score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever their names."""
    # the text travels once, under its own name
    names = {"text" if name == "text" else f"c{k}": name for k, name in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{name}`").alias(short) for short, name in names.items()])
    good = score(rows, train(docs, labels), *names).where("_score >= 0.5")
    return good.select(*[F.col(short).alias(name) for short, name in names.items()])
