"""Vector retrieval: exact cosine top-k and an inverted-list index.

Vectors are packed into blocks of a few thousand rows and each block of the
collection meets each block of questions in one matrix product inside an Arrow
batch. Only a block's best k per question leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.operators.joins import ROW_BYTES, broadcast_if
from talkmill.session import cut_lineage, scratch_path, ship_package

BLOCK_ROWS = 2048
QUERY_BLOCK_ROWS = 1024
ROWS_PER_FILE = 250_000
BROADCAST_BYTES = 64 * 1024 * 1024
DISTANCE_DIGITS = 6
# Vectors of one ring of an index's list.
RING_ROWS = 512
# Sampled vectors for each list's centre.
FIT_ROWS = 256
# The nearest lists that a search begins with, and more if they hold too few vectors.
SEED_LISTS = 2
# Of the (question, block) pairs, the share beyond which a search scans all blocks at once.
SCAN_SHARE = 0.5
# Blocks that are named in a pushed filter.
PUSHED_BLOCKS = 10_000

_CORPUS_BLOCK = "part long, ids binary, owners binary, vectors binary, n int"
_QUERY_BLOCK = "part long, q_ids binary, q_owners binary, q_vectors binary, q_n int"
_NO_OWNER = np.iinfo(np.int64).min


def _pack_rows(batch, names: list[str], rows_per_block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one Arrow batch with columns part, id, owner, embedding."""
    parts = batch.column("part").to_numpy(zero_copy_only=False)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    owners = batch.column("owner").fill_null(_NO_OWNER).to_numpy(zero_copy_only=False)
    vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    vectors = vectors.reshape(len(ids), -1)
    for part in np.unique(parts):
        members = np.flatnonzero(parts == part)
        for start in range(0, len(members), rows_per_block):
            pick = members[start : start + rows_per_block]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part)], pa.int64()),
                    pa.array([ids[pick].astype(np.int64).tobytes()], pa.binary()),
                    pa.array([owners[pick].astype(np.int64).tobytes()], pa.binary()),
                    pa.array([vectors[pick].tobytes()], pa.binary()),
                    pa.array([len(pick)], pa.int32()),
                ],
                names=names,
            )


def _pack_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _pack_rows(batch, ["part", "ids", "owners", "vectors", "n"], BLOCK_ROWS)


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _pack_rows(batch, ["part", "q_ids", "q_owners", "q_vectors", "q_n"], QUERY_BLOCK_ROWS)


def _matrix(buffer: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(buffer, np.float32).reshape(rows, -1).astype(np.float64)


def _best_in_block(k: int):
    """Arrow function: (collection block, question block) rows to their best k pairs."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, owners = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owners"], np.int64)
                q_ids, q_owners = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_owners"], np.int64)
                left, right = _matrix(row["q_vectors"], row["q_n"]), _matrix(row["vectors"], row["n"])
                with np.errstate(invalid="ignore", divide="ignore"):
                    lengths = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
                    # adding zero turns a rounded -0.0 into 0.0
                    distances = np.round(1.0 - (left @ right.T) / lengths, DISTANCE_DIGITS) + 0.0
                # not-a-number sorts after every distance but still counts as a row
                keys = np.where(np.isnan(distances), np.inf, distances)
                out_q, out_id, out_d = [], [], []
                for at, query in enumerate(q_ids):
                    allowed = np.arange(len(ids)) if q_owners[at] == _NO_OWNER else np.flatnonzero(owners == q_owners[at])
                    near = keys[at, allowed]
                    if len(near) > k:
                        allowed = allowed[near <= np.partition(near, k - 1)[k - 1]]
                    chosen = allowed[np.lexsort((ids[allowed], keys[at, allowed]))[:k]]
                    out_q.append(np.full(len(chosen), query, np.int64))
                    out_id.append(ids[chosen])
                    out_d.append(distances[at, chosen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(part)) for part in (out_q, out_id, out_d)],
                    names=["query_id", "id", "distance"],
                )

    return best


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(corpus: DataFrame, queries: DataFrame, k: int, query_bytes: int | None = None) -> DataFrame:
    """Join blocks on ``part`` and keep the best k pairs of each.

    Question blocks of a small checked size are broadcast. Otherwise both sides
    are shuffled, with the collection spread over salts so that no part ends in one task.
    """
    if query_bytes is None or query_bytes <= BROADCAST_BYTES:
        met = corpus.join(queries if query_bytes is None else F.broadcast(queries), "part")
    else:
        salts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = corpus.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
        copies = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = spread.join(copies, ["part", "salt"])
    columns = ["ids", "owners", "vectors", "n", "q_ids", "q_owners", "q_vectors", "q_n"]
    best = met.select(*columns).mapInArrow(_best_in_block(k), "query_id long, id long, distance double")
    return _rank(best, k)


def _rows(vectors: DataFrame, key: str, owner, part, width: int) -> DataFrame:
    """Rows for packing. A vector of another width, or with a null element, is an error."""
    ship_package(vectors.sparkSession)
    numbers = F.col("embedding").cast("array<float>")
    right = (F.size(numbers) == width) & ~F.exists(numbers, lambda x: x.isNull())
    problem = F.format_string(
        f"vector %s of {key} %s does not hold {width} numbers", F.to_json(numbers), F.col(key).cast("string")
    )
    checked = F.when(right, numbers).otherwise(F.raise_error(problem).cast("array<float>"))
    return vectors.where(F.col("embedding").isNotNull()).select(
        part.cast("long").alias("part"), F.col(key).cast("long").alias("id"), owner.cast("long").alias("owner"),
        checked.alias("embedding"),
    )


def _extent(queries: DataFrame) -> tuple[int, int, int]:
    """Number of question vectors, their width and their total bytes."""
    count, width = queries.where(F.col("embedding").isNotNull()).agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))
    ).first()
    return count, width, count * width * 4


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact search over the whole collection.

    Questions are taken in groups that are small enough to broadcast, one scan of
    the collection each; the collection is never shuffled.
    """
    count, width, size = _extent(queries)
    groups = max(1, -(-size // BROADCAST_BYTES))
    found = None
    for group in range(groups):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group) if groups > 1 else queries
        blocks = max(1, -(-count // (groups * QUERY_BLOCK_ROWS)))
        packed = _rows(vectors, "id", F.lit(None), F.lit(0), width).mapInArrow(_pack_corpus, _CORPUS_BLOCK)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        questions = (
            _rows(asked, "query_id", F.lit(None), F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)), width)
            .repartition(blocks, "part")
            .mapInArrow(_pack_queries, _QUERY_BLOCK)
        )
        part = _meet(packed.withColumn("part", every), F.broadcast(questions), k)
        found = part if found is None else found.unionByName(part)
    return found


def _nearest_of_user(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Search of questions that only see one user's vectors: both sides are keyed by the user.

    Only vectors of users that were asked about are packed.
    """
    count, width, size = _extent(queries)
    owners = queries.select(F.col("user_id").alias("_owner")).distinct()
    owned = vectors.join(broadcast_if(owners, count * ROW_BYTES), F.col("user_id") == F.col("_owner"), "left_semi")
    packed = _rows(owned, "id", F.lit(None), F.col("user_id"), width).mapInArrow(_pack_corpus, _CORPUS_BLOCK)
    questions = (
        _rows(queries, "query_id", F.lit(None), F.col("user_id"), width)
        .repartition("part")
        .mapInArrow(_pack_queries, _QUERY_BLOCK)
    )
    return _meet(packed, questions, k, size)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, by_user: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of every question.

    ``vectors``: id, embedding, user_id; ``queries``: query_id, embedding and,
    with ``by_user``, user_id: a question with a user only sees that user's
    vectors. Ascending cosine distance, lower id first on a tie, NaN last.
    """
    if not by_user:
        return _nearest(vectors, queries, k)
    free = _nearest(vectors, queries.where(F.col("user_id").isNull()), k)
    return free.unionByName(_nearest_of_user(vectors, queries.where(F.col("user_id").isNotNull()), k))


def with_content(results: DataFrame, contents: DataFrame, result_rows: int) -> DataFrame:
    """Attach the ``content`` of the found ids (contents: id, content)."""
    return contents.join(broadcast_if(results, result_rows * ROW_BYTES), "id", "right")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row without direction stays as it is."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of the unit vectors (rows) to the centres (columns)."""
    unit = _unit(vectors)
    squares = (unit**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2.0 * unit @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def _flat(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _listed(centres):
    """Arrow function: rows (part, id, owner, embedding) with the nearest centre as part, and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = _gaps(_flat(batch.column("embedding"), centres.value.shape[1]), centres.value)
            nearest = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nearest.astype(np.int64)), *batch.columns[1:],
                    pa.array(gaps[np.arange(len(gaps)), nearest]),
                ],
                names=[*batch.schema.names, "gap"],
            )

    return assign


def _packed_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, gap) to blocks of one list, each a ring around its centre from lo to hi."""
    for batch in batches:
        gaps = batch.column("gap").to_numpy(zero_copy_only=False)
        if not len(gaps):
            continue
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
        for begin, end in zip(starts, starts[1:]):
            for at in range(begin, end, RING_ROWS):
                ring = batch.slice(at, min(RING_ROWS, end - at))
                packed = next(_pack_rows(ring.drop_columns(["gap"]), ["list_id", "ids", "owners", "vectors", "n"], RING_ROWS))
                own = gaps[at : at + ring.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [*packed.columns, pa.array([own.min()]), pa.array([own.max()])], names=[*packed.schema.names, "lo", "hi"]
                )


def _reached(lists, slack: float):
    """Arrow function: questions (query_id, embedding, bound) to (query_id, list_id, gap, bound) of the lists whose ball
    their bound reaches. Without a bound, the nearest lists that hold enough rows, see ``SEED_LISTS``."""
    centres, radius, counts, k = lists

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column("bound").to_numpy(zero_copy_only=False)
            gaps = _gaps(_flat(batch.column("embedding"), centres.value.shape[1]), centres.value)
            out = []
            for at in range(len(gaps)):
                if np.isnan(bounds[at]):
                    nearest = np.argsort(gaps[at], kind="stable")
                    enough = np.searchsorted(np.cumsum(counts[nearest]), k) + 1
                    out.append(nearest[: max(SEED_LISTS, enough)])
                else:
                    out.append(np.flatnonzero((gaps[at] - radius) * (1 + slack) <= bounds[at]))
            sizes = np.array([len(x) for x in out], np.int64)
            lists_of = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
            rows = np.repeat(np.arange(len(out)), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(rows)), pa.array(lists_of), pa.array(gaps[rows, lists_of]), pa.array(bounds[rows])],
                names=["query_id", "list_id", "gap", "bound"],
            )

    return reach


class InvertedLists:
    """Vectors divided into lists around cluster centres, each list into rings by the distance to its centre.

    A block of the stored table is one ring of a list: up to ``RING_ROWS``
    packed vectors with the least and greatest distance to the centre. Tables are
    in a shared folder, partitioned by list, and can be loaded again.

    ``search`` is exact. The nearest lists give every question k candidates and so
    a bound for its k-th distance. By the triangle inequality a vector of a ring [lo,
    hi] is at least ``max(gap - hi, lo - gap)`` from a question whose distance to
    the centre is ``gap``, so only rings within the bound are read. With
    ``slack`` a ring is also skipped when its bound times ``1 + slack`` is beyond:
    what is missed is no nearer than the k-th found distance over ``1 + slack``
    (Euclidean, between unit vectors). When the bounds leave more than
    ``SCAN_SHARE`` of the (question, block) pairs, as they must for vectors
    without clusters, all blocks are scanned at once instead.

    With ``probes`` only that many lists are read, without a guarantee.
    """

    def __init__(
        self, vectors: DataFrame, lists: int | None = None, seed: int = 7, max_iter: int = 10, folder: str | None = None
    ):
        """``lists``: as many as the square root of the number of vectors unless given. Centres are fitted on a sample of
        about ``FIT_ROWS`` vectors a list; every vector is indexed."""
        spark = vectors.sparkSession
        present = vectors.where(F.col("embedding").isNotNull())
        count, width = present.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        lists = lists or max(1, round(count**0.5))
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
        # a vector without direction goes to the centres as it is
        unit = F.transform("embedding", lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
        sample = present if count <= FIT_ROWS * lists else present.sample(FIT_ROWS * lists / count, seed)
        fitted = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(sample.select(array_to_vector(unit).alias("features")))
        centres = np.array(fitted.clusterCenters())
        # bounded by ``lists``
        shipped = spark.sparkContext.broadcast(centres)
        rows = _rows(present, "id", F.col("user_id") if "user_id" in vectors.columns else F.lit(None), F.lit(0), width)
        listed = rows.mapInArrow(_listed(shipped), "part long, id long, owner long, embedding array<float>, gap double")
        # a list is one file for each ROWS_PER_FILE of its rows, not one for each task
        files = max(1, -(-count // (lists * ROWS_PER_FILE)))
        ordered = listed.repartition("part", F.pmod(F.xxhash64("id"), F.lit(files))).sortWithinPartitions("part", "gap")
        blocks = ordered.mapInArrow(_packed_rings, "list_id long, ids binary, owners binary, vectors binary, n int, lo double, hi double")
        folder = folder or scratch_path(spark, "vector-lists")
        # small row groups, so that a reader can skip blocks
        blocks.withColumn("block", F.monotonically_increasing_id()).write.option("parquet.block.size", 4 * 1024 * 1024).partitionBy(
            "list_id"
        ).parquet(f"{folder}/blocks")
        named = [(number, [float(x) for x in centre]) for number, centre in enumerate(centres)]
        spark.createDataFrame(named, "id long, embedding array<double>").write.parquet(f"{folder}/centres")
        self._open(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> InvertedLists:
        """The index that was written to a folder."""
        found = cls.__new__(cls)
        found._open(spark, folder)
        return found

    def _open(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        kinds = "ids binary, owners binary, vectors binary, n int, lo double, hi double, block long, list_id int"
        self.table = spark.read.schema(kinds).parquet(f"{folder}/blocks")
        stored = spark.read.parquet(f"{folder}/centres").orderBy("id").collect()
        self.lists = len(stored)
        self._centres = np.array([row.embedding for row in stored], np.float64).reshape(self.lists, -1)
        self.centres = spark.createDataFrame(
            [(row.id, row.embedding) for row in stored], "id long, embedding array<float>"
        ).withColumn("user_id", F.lit(None).cast("long"))
        sizes = self.table.groupBy("list_id").agg(F.sum("n").alias("n"), F.max("hi").alias("radius"), F.count(F.lit(1)).alias("blocks"))
        self._counts, self._radius = np.zeros(self.lists, np.int64), np.full(self.lists, -np.inf)
        self.blocks = 0
        for row in sizes.collect():  # one row per list
            self._counts[row.list_id], self._radius[row.list_id] = row.n, row.radius
            self.blocks += row.blocks
        self.rows = int(self._counts.sum())
        ship_package(spark)
        self._shipped = spark.sparkContext.broadcast(self._centres)

    def _pairs(self, queries: DataFrame, k: int, slack: float) -> DataFrame:
        """(query_id, block, n) of the blocks that the questions (query_id, embedding, bound) reach."""
        lists = (self._shipped, self._radius, self._counts, k)
        wanted = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"), "bound")
        reached = wanted.mapInArrow(_reached(lists, slack), "query_id long, list_id long, gap double, bound double")
        rings = self.table.select("block", F.col("list_id").cast("long").alias("list_id"), "lo", "hi", "n")
        rings = broadcast_if(rings, self.blocks * ROW_BYTES)
        least = F.greatest(F.col("gap") - F.col("hi"), F.col("lo") - F.col("gap"))
        near = F.isnan("bound") | (least * (1 + slack) <= F.col("bound"))
        return reached.join(rings, "list_id").where(near).select("query_id", "block", "n")

    def _compare(self, queries: DataFrame, pairs: DataFrame, k: int, width: int) -> DataFrame:
        """The best k of each question among the blocks it is paired with."""
        number, low, high = pairs.agg(F.count(F.lit(1)), F.min("block"), F.max("block")).first()
        targets = queries.join(pairs.select("query_id", "block"), "query_id")
        questions = (
            _rows(targets, "query_id", F.lit(None), F.col("block"), width).repartition("part").mapInArrow(_pack_queries, _QUERY_BLOCK)
        )
        wanted = pairs.select("block").distinct()
        read = self.table.where(F.col("block").between(low or 0, high or 0))
        if number <= PUSHED_BLOCKS:
            # a list of bounded length; row groups without any of them are skipped
            read = read.where(F.col("block").isin([row.block for row in wanted.collect()]))
        corpus = read.select(F.col("block").alias("part"), "ids", "owners", "vectors", "n")
        return _meet(corpus, questions, k, number * width * 4)

    def _scan(self, queries: DataFrame, k: int, count: int, width: int) -> DataFrame:
        """All blocks against all questions, in groups of questions that are small enough to broadcast."""
        groups = max(1, -(-count * width * 4 // BROADCAST_BYTES))
        found = None
        for group in range(groups):
            asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group) if groups > 1 else queries
            questions = _rows(asked, "query_id", F.lit(None), F.lit(0), width).repartition(1).mapInArrow(_pack_queries, _QUERY_BLOCK)
            # a generated part: the optimiser would take a literal one for a join without a key
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))).alias("part")
            corpus = self.table.select(every, "ids", "owners", "vectors", "n")
            part = _meet(corpus, questions, k, 0)
            found = part if found is None else found.unionByName(part)
        return found

    def plan(self, queries: DataFrame, k: int = 5, slack: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """The questions' first results with their ``bound``, and the (query_id, block, n) that they still have to read."""
        _, width, _ = _extent(queries)
        asked = queries.where(F.col("embedding").isNotNull())
        none = F.lit(float("nan"))
        seeds = cut_lineage(self._pairs(asked.withColumn("bound", none), k, slack))
        first = cut_lineage(self._compare(asked, seeds, k, width))
        kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("kth"))
        # beyond rounding; a question without k finite distances has to see everything
        bound = F.when(F.col("kth").isNull() | F.isnan("kth"), float("inf")).otherwise(F.sqrt(2 * (F.col("kth") + 2e-6)) + 1e-6)
        bounded = asked.join(broadcast_if(kth, ROW_BYTES * first.count()), "query_id", "left").withColumn("bound", bound)
        pairs = self._pairs(bounded, k, slack).join(seeds.select("query_id", "block"), ["query_id", "block"], "left_anti")
        return first, cut_lineage(pairs)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, slack: float = 0.0) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest vectors of every question (query_id, embedding), see the class."""
        if probes is not None:
            return self._probe(queries, k, probes)
        count, width, _ = _extent(queries)
        if not self.rows or not count:
            return vector_topk(self.centres.limit(0), queries, k)
        first, pairs = self.plan(queries, k, slack)
        if pairs.count() > SCAN_SHARE * count * self.blocks:
            return self._scan(queries, k, count, width)
        rest = self._compare(queries, pairs, k, width)
        return _rank(first.drop("rank").unionByName(rest.drop("rank")), k)

    def rows_read(self, queries: DataFrame, k: int = 5, slack: float = 0.0) -> DataFrame:
        """(query_id, rows_compared, rows): how many vectors a search compares with each question, of how many."""
        seeds = self._pairs(queries.where(F.col("embedding").isNotNull()).withColumn("bound", F.lit(float("nan"))), k, slack)
        _, pairs = self.plan(queries, k, slack)
        return seeds.unionByName(pairs).groupBy("query_id").agg(
            F.sum("n").alias("rows_compared"), F.lit(self.rows).cast("long").alias("rows")
        )

    def _probe(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """The k nearest among the vectors of the ``probes`` nearest lists; exact with as many as there are."""
        _, width, size = _extent(queries)
        probed = cut_lineage(
            vector_topk(self.centres, queries, probes).select("query_id", F.col("id").alias("list_id"))
        )
        # at most one value per list: a literal filter prunes the partitions of the other lists
        wanted = [row.list_id for row in probed.select("list_id").distinct().collect()]
        targets = queries.join(probed, "query_id")
        questions = (
            _rows(targets, "query_id", F.lit(None), F.col("list_id"), width)
            .repartition("part")
            .mapInArrow(_pack_queries, _QUERY_BLOCK)
        )
        listed = self.table.where(F.col("list_id").isin(wanted))
        corpus = listed.select(F.col("list_id").cast("long").alias("part"), "ids", "owners", "vectors", "n")
        return _meet(corpus, questions, k, size * probes)
