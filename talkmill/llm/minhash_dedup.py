"""MinHash near-duplicates with sequential Bayesian verification, and the components of their links.

1. Every document becomes its set of distinct three-word shingles and ``HASHES``
   minima of that set. Documents with equal sets are one node from here on.
2. Bands of ``ROWS`` minima are buckets. Two sets that link share one of ``BANDS``
   buckets but for a chance of ``(1 - 0.85 ** 7) ** 36``, below one in a million.
3. Candidates are verified batch by batch of ``BATCH`` signature values. After k
   values of which m agree, the similarity of the sets has the posterior
   Beta(m + 1, k - m + 1) (every similarity is equally likely before). A pair is
   dropped as soon as its chance of reaching the link's similarity is below
   ``MISS``, so few batches are read of unlike pairs.
4. Survivors are compared by their whole sets: no link rests on signatures.

Not all pairs of a bucket are candidates, as only components are wanted. Each
bucket's first node is held against the others, in a quarter of the buckets first,
and links are joined to components. Then only buckets whose nodes are in
several components are left. Nodes of different components are paired in
buckets of up to ``SMALL_BUCKET`` nodes. Larger buckets are dealt as blocks:
a chunk of the nodes outside the bucket's largest component meets a chunk
of its nodes in one task, which verifies in the same way and returns only links
that join components. After that every pair of every bucket is connected or
compared.

Shuffled are one row per band and document, the signatures of candidates, and the
sets of survivors. A node's signature and set are made once more from its text,
only for nodes that share a bucket.

Defined results: A-Z are lower-cased; a text with fewer than three words is one
shingle; a null text or one without words has no shingle, links with nothing, is
its own component and stays; equal rows are separate rows of one component; rows
without doc_id take part, but do not name a component: they stay only if it has no
other row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from talkmill.llm.common import take_columns
from talkmill.llm.components import components
from talkmill.llm.shingles import mix, overlap, shingle_set
from talkmill.operators.joins import broadcast_if
from talkmill.session import cut_lineage, scratch_path, ship_package

WIDTH = 3
# Two sets link when LINK[1] * intersection >= LINK[0] * union.
LINK = (85, 100)
BANDS, ROWS = 36, 7
HASHES, BATCH = 256, 32
# The chance of linking below which a pair is dropped.
MISS = 1e-6
SMALL_BUCKET = 16
# Nodes on each side of a block.
CHUNK = 512
# Bytes of a node's row in a broadcast table.
ROW_BYTES = 64
# Shingles whose minima are taken at once.
_STEP = 512
_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of a set that is not empty under each of the hash functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), _STEP):
        np.minimum(least, (values[at : at + _STEP, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least


def _buckets(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total + rows[:, k])
    return total.view(np.int64)


def _signature(least: np.ndarray) -> bytes:
    return (least >> np.uint64(48)).astype(np.uint16).tobytes()


def _key(values: np.ndarray) -> bytes | None:
    return xxh3_128_digest(values.tobytes()) if len(values) else None


@lru_cache
def least_matches(similarity: float, miss: float) -> np.ndarray:
    """For every batch, the fewest agreeing values that leave a pair its chance.

    The posterior's weight above s is a binomial tail: the chance that of k + 1
    trials with success s at most m succeed.
    """
    bounds = []
    for k in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(k + 1, m) * similarity**m * (1 - similarity) ** (k + 1 - m)
        bounds.append(m)
    return np.array(bounds)


def survivors(left: np.ndarray, right: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """Places of the pairs (rows of two signature matrices) that no batch rules out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(similarity, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, HASHES)


def _linked(a: np.ndarray, b: np.ndarray, link: tuple[int, int]) -> bool:
    shared = overlap(a, b)
    return shared * link[1] >= (len(a) + len(b) - shared) * link[0]


Batches = Iterator[pa.RecordBatch]


def _measured(width: int) -> Callable[[Batches], Batches]:
    """Arrow function: (doc_id, text_hash, text) to (doc_id, text_hash, n, key, bands)."""

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(2).to_pylist():
                values = shingle_set(text, width)
                sizes.append(len(values))
                keys.append(_key(values))
                bands.append(_buckets(minima(values)) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n", "key", "bands"],
            )

    return measure


def _signed(width: int) -> Callable[[Batches], Batches]:
    """Arrow function: (node, text) to (node, signature, shingles)."""

    def sign(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([_signature(minima(values)) for values in sets], pa.binary()),
                    pa.array([values.tobytes() for values in sets], pa.binary()),
                ],
                names=["node", "signature", "shingles"],
            )

    return sign


def _possible(similarity: float, miss: float) -> Callable[[Batches], Batches]:
    """Arrow function: (a, b, signature_a, signature_b) to the pairs (a, b) that survive."""

    def check(batches: Batches) -> Batches:
        for batch in batches:
            sides = [_matrix(batch.column(name).to_pylist()) for name in ("signature_a", "signature_b")]
            yield batch.select(["a", "b"]).take(pa.array(survivors(*sides, similarity, miss)))

    return check


def _confirmed(link: tuple[int, int]) -> Callable[[Batches], Batches]:
    """Arrow function: (a, b, shingles_a, shingles_b) to the pairs (a, b) that link."""

    def confirm(batches: Batches) -> Batches:
        for batch in batches:
            sides = zip(*(batch.column(name).to_pylist() for name in ("shingles_a", "shingles_b")))
            right = [_linked(*(np.frombuffer(side, np.uint64) for side in pair), link) for pair in sides]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return confirm


def _block(link: tuple[int, int], miss: float) -> Callable[[pa.Table], pa.Table]:
    """Arrow function: one block's rows (outer, node, component, outside, n, signature, shingles) to links (a, b)
    that join its components. ``outer`` marks the side of nodes outside the bucket's largest component."""
    similarity = link[0] / link[1]

    def compare(rows: pa.Table) -> pa.Table:
        outer = rows.column("outer").to_numpy()
        node, component, n = (rows.column(name).to_numpy() for name in ("node", "component", "n"))
        outside = rows.column("outside").to_numpy()
        signatures = _matrix(rows.column("signature").to_pylist())
        shingles = rows.column("shingles")
        inner = np.flatnonzero(~outer)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for at in np.flatnonzero(outer):
            few, many = np.minimum(n[inner], n[at]), np.maximum(n[inner], n[at])
            # two nodes outside meet twice
            fits = (few * link[1] >= many * link[0]) & (component[inner] != component[at])
            fits &= ~outside[inner] | (node[inner] > node[at])
            others = inner[fits]
            left = np.broadcast_to(signatures[at], (len(others), HASHES))
            mine = np.frombuffer(shingles[int(at)].as_py(), np.uint64)
            for other in others[survivors(left, signatures[others], similarity, miss)]:
                here, there = root(int(component[at])), root(int(component[other]))
                if here != there and _linked(mine, np.frombuffer(shingles[int(other)].as_py(), np.uint64), link):
                    parent[here] = there
                    found.append((int(node[at]), int(node[other])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


class MinHashDedup:
    """Near-duplicates of one table of documents (doc_id, text)."""

    def __init__(
        self, docs: DataFrame, width: int = WIDTH, link: tuple[int, int] = LINK, miss: float = MISS, small_bucket: int = SMALL_BUCKET
    ):
        self.spark = docs.sparkSession
        ship_package(self.spark)
        self.width, self.link, self.miss, self.small = width, link, miss, small_bucket
        self.docs = take_columns(docs, doc_id="doc_id", text="text").select(
            "doc_id", F.xxhash64("text").alias("text_hash"), "text"
        )
        self._measure()
        self._join()

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"minhash-{name}")
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _measure(self) -> None:
        key = self.docs.schema["doc_id"].dataType.simpleString()
        self.found = self._kept(
            self.docs.mapInArrow(
                _measured(self.width), f"doc_id {key}, text_hash long, n long, key binary, bands array<long>"
            ),
            "sets",
        )
        nodes = self.found.where("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("least"), F.any_value(F.struct("doc_id", "text_hash")).alias("one"),
            F.any_value("n").alias("n"), F.any_value("bands").alias("bands"),
        )
        # written once, so the numbers stay
        self.nodes = self._kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        rows = self.nodes.select("node", F.explode("bands").alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size"))
        self.members = self._kept(rows.join(shared.where("size > 1"), "bucket"), "members")

    def _sign(self) -> None:
        """(node, n, signature, shingles) of the nodes that share a bucket, from the text of one of their rows."""
        wanted = cut_lineage(
            self.nodes.join(self.members.select("node").distinct(), "node", "left_semi").select(
                "node", F.col("one.doc_id").alias("its_id"), F.col("one.text_hash").alias("its_hash")
            )
        )
        wanted = broadcast_if(wanted, ROW_BYTES * wanted.count())
        same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash"))
        texts = self.docs.join(wanted, same).select("node", "text")
        signed = texts.mapInArrow(_signed(self.width), "node long, signature binary, shingles binary")
        # repeated rows have one node
        once = signed.groupBy("node").agg(F.any_value("signature").alias("signature"), F.any_value("shingles").alias("shingles"))
        self.signed = self._kept(once.join(self.nodes.select("node", "n"), "node"), "signed")

    def _both(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs (a, b) with columns of both nodes."""
        for side in "ab":
            known = self.signed.select(F.col("node").alias(side), *[F.col(name).alias(f"{name}_{side}") for name in columns])
            pairs = pairs.join(known, side)
        return pairs.select("a", "b", *[f"{name}_{side}" for name in columns for side in "ab"])

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: by size, by signatures batch by batch, then by whole sets."""
        sized = self._both(pairs, "n", "signature")
        fits = F.least("n_a", "n_b") * self.link[1] >= F.greatest("n_a", "n_b") * self.link[0]
        possible = sized.where(fits).select("a", "b", "signature_a", "signature_b").mapInArrow(
            _possible(self.link[0] / self.link[1], self.miss), "a long, b long"
        )
        return self._both(self._kept(possible, "possible"), "shingles").mapInArrow(_confirmed(self.link), "a long, b long")

    def _connect(self, links: DataFrame) -> None:
        edges = self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
        self.labels = self._kept(components(edges), "labels")

    def _labelled(self, rows: DataFrame, name: str = "node", as_name: str = "component") -> DataFrame:
        label = self.labels.select(F.col("node").alias(name), F.col("component").alias(as_name))
        return rows.join(label, name, "left").withColumn(as_name, F.coalesce(as_name, name))

    def _round(self, pairs: DataFrame) -> None:
        """Verify the pairs that are not connected or compared yet, and connect those that link."""
        apart = self._labelled(self._labelled(pairs.distinct(), "a", "c_a"), "b", "c_b").where("c_a <> c_b").select("a", "b")
        for done in self.compared:
            apart = apart.join(done, ["a", "b"], "left_anti")
        apart = self._kept(apart, "pairs")
        if apart.isEmpty():
            return
        self.compared.append(apart)
        self._connect(self._links(apart))

    def _mixed(self) -> DataFrame:
        """(bucket, node, component, size) of buckets whose nodes are in several components, beyond pairs."""
        rows = self._labelled(self.members.where("size > 2").select("bucket", "node", "size"))
        kinds = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return self._kept(rows.join(kinds.where("lo < hi").select("bucket"), "bucket"), "mixed")

    def _join(self) -> None:
        self.labels = self.spark.createDataFrame([], "node long, component long")
        self.compared: list[DataFrame] = []
        if self.members.isEmpty():
            return
        self._sign()
        firsts = self.members.where("first <> node").select("bucket", F.col("first").alias("a"), F.col("node").alias("b"))
        # a quarter of the buckets connects most of what links
        self._round(firsts.where("bucket % 4 = 0").select("a", "b"))
        self._round(firsts.select("a", "b"))
        mixed = self._mixed()
        left = mixed.where(F.col("size") <= self.small)
        right = left.select("bucket", F.col("node").alias("b"), F.col("component").alias("c_b"))
        pairs = left.join(right, "bucket").where("node < b and component <> c_b")
        self._round(pairs.select(F.col("node").alias("a"), "b"))
        self._blocks()

    def _blocks(self) -> None:
        """Compare what is left in large buckets, in blocks of bounded size."""
        rows = self._mixed().where(F.col("size") > self.small)
        parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"))
        largest = parts.groupBy("bucket").agg(
            F.max_by("component", F.struct("members", "component")).alias("largest"),
            (F.sum("members") - F.max("members")).alias("out"),
        )
        rows = rows.join(largest, "bucket").withColumn("outside", F.col("component") != F.col("largest"))
        chunks = lambda size: F.ceil(F.col(size) / CHUNK).cast("int")
        own = lambda size: F.pmod(F.xxhash64("node"), chunks(size)).cast("int")
        every = lambda size: F.explode(F.sequence(F.lit(0), chunks(size) - 1))
        columns = ("bucket", "node", "component", "outside")
        outer = rows.where("outside").select(*columns, F.lit(True).alias("outer"), own("out").alias("o"), "size").select(
            *columns, "outer", "o", every("size").alias("m")
        )
        inner = rows.select(*columns, F.lit(False).alias("outer"), every("out").alias("o"), own("size").alias("m"))
        dealt = outer.unionByName(inner).join(self.signed, "node")
        links = dealt.groupBy("bucket", "o", "m").applyInArrow(_block(self.link, self.miss), "a long, b long")
        links = self._kept(links.distinct(), "block-links")
        if not links.isEmpty():
            self._connect(links)

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) of every row."""
        label = self._labelled(self.nodes.select("key", "node", "least"))
        names = label.groupBy("component").agg(F.min("least").alias("name"))
        named = label.join(names, "component").select("key", "name")
        rows = self.found.select("doc_id", "n", "key").join(named, "key", "left").withColumn(
            "component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("name"))
        )
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, link: tuple[int, int] = LINK, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text)."""
    return MinHashDedup(docs, width, link, miss).documents()
