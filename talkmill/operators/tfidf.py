"""Keyword retrieval: TF-IDF weights and cosine top-k for batches of questions.

``fit`` writes the model once (an idf table and a weights table bucketed by
document); any number of ``search`` calls read it. Every row of a document
lies in one bucket, so the norms need no shuffle after the first one and the
scores of a (question, document) pair are summed without shuffling pairs: only
each task's best k per question are.

Questions that can be broadcast meet the documents in blocks: a block of
documents and a block of questions give one small matrix of scores inside an
Arrow batch, of which the best k per question are kept. Neither pairs nor
weights are shuffled or written, and a task's memory does not depend on the
size of the collection.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.stopwords import ENGLISH_STOP_WORDS
from talkmill.functions.text import TOKEN
from talkmill.operators.joins import BROADCAST_BYTES, ROW_BYTES, broadcast_if, lookup_join, measured_bytes
from talkmill.session import cut_lineage, remove_path, scratch_path, ship_package

# A term is hot with more than 1/HOT_TERMS of all postings, or a quarter of a bucket's share where there are more
# buckets than that; so many terms can be hot at most.
HOT_TERMS = 2000
# Terms of questions that are pushed into the scan of the weights; more are only joined.
PUSHED_TERMS = 2000
# A task counts, joins and sorts the terms of one bucket, which takes some forty times the bytes of its texts.
BYTES_PER_BUCKET = 8 * 1024 * 1024
SCORE_DIGITS = 6
# Two rounding steps of a score; a bound has to miss by more to rule a document out.
MARGIN = 2 * 10.0**-SCORE_DIGITS
# Pairs of questions and documents that one task may sum up without pruning.
DIRECT_PAIRS_PER_TASK = 20_000_000
MIN_DOCUMENTS_PER_BUCKET = 250
# Documents and questions whose scores are one matrix.
BLOCK_DOCUMENTS = 1024
BLOCK_QUESTIONS = 512
# Products of weights that are summed up at a time.
PRODUCTS = 1 << 20


def term_counts(texts: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(key, term, tf): how often each token occurs in each text."""
    found = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term"))
    if stop_words:
        found = found.where(~F.col("term").isin(*stop_words))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_document_frequency(counts: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log((F.lit(1.0) + F.lit(documents)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    )


def unit_weights(weighted: DataFrame, key: str) -> DataFrame:
    """Scale the weights of every text to length one."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.col("w") / norm).select(key, "term", "weight")


@dataclass(frozen=True)
class TfidfModel:
    """A fitted model: tables, not state in a process."""

    idf: DataFrame  # term, df, idf
    weights: DataFrame  # doc_id, term, weight
    idf_bytes: int
    postings: int
    documents: int
    buckets: int
    folder: str
    table: str

    def hot_terms(self) -> DataFrame:
        """Terms in so many documents that one partition should not hold them; a bounded list."""
        return self.idf.where(F.col("df") > self.postings / _hot_limit(self.buckets))

    def drop(self) -> None:
        """Remove the model's table and files."""
        self.idf.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_path(self.idf.sparkSession, self.folder)


def _hot_limit(buckets: int) -> int:
    return max(HOT_TERMS, 4 * buckets)


def load(spark, folder: str) -> TfidfModel:
    """A model that ``fit`` has written to ``folder``, also from another session."""
    idf = spark.read.parquet(f"{folder}/idf")
    meta = spark.read.json(f"{folder}/meta").first()
    name = f"tfidf_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/weights").schema)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term) "
        f"INTO {meta.buckets} BUCKETS LOCATION '{folder}/weights'"
    )
    return TfidfModel(
        idf, spark.table(name), meta.idf_bytes, meta.postings, meta.documents, meta.buckets, folder, name
    )


def fit(
    docs: DataFrame, key: str = "id", text: str = "question", stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS,
    folder: str | None = None,
) -> TfidfModel:
    """Fit the model over a collection and write it to ``folder`` or the shared folder.

    The texts are shuffled and tokenised once: the token counts are written
    bucketed by document, and idf and weights are read off that table. Buckets
    hold equal amounts of text, so a larger collection has more of them and a
    task's memory stays the same.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tfidf")
    documents, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # buckets follow the bytes of the texts; a small collection has one for each core
    cores = min(spark.sparkContext.defaultParallelism, -(-documents // MIN_DOCUMENTS_PER_BUCKET))
    buckets = max(1, cores, -(-size // BYTES_PER_BUCKET))
    placed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartition(buckets, "doc_id")
    counts, counts_name = _bucketed(term_counts(placed, "doc_id", "text", stop_words), f"{folder}/counts", buckets)

    inverse_document_frequency(counts, documents).write.parquet(f"{folder}/idf")
    idf = spark.read.parquet(f"{folder}/idf")
    idf_bytes = measured_bytes(idf, "term")
    postings = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot = idf.where(F.col("df") > postings / _hot_limit(buckets))

    weighted = lookup_join(
        counts, idf.select("term", "idf"), "term", lookup_bytes=idf_bytes, hot=hot, spread_by="doc_id", salts=buckets
    ).withColumn("w", F.col("tf") * F.col("idf"))
    if idf_bytes > BROADCAST_BYTES:
        # the join has dealt the rows by term; back to the buckets they are weighed and written in
        weighted = weighted.repartition(buckets, "doc_id")
    weights, name = _bucketed(unit_weights(weighted, "doc_id"), f"{folder}/weights", buckets)
    meta = {"idf_bytes": idf_bytes, "postings": postings, "documents": documents, "buckets": buckets}
    spark.createDataFrame([meta]).coalesce(1).write.json(f"{folder}/meta")
    # the counts are not needed any more
    spark.sql(f"DROP TABLE {counts_name}")
    remove_path(spark, f"{folder}/counts")
    return TfidfModel(idf, weights, idf_bytes, postings, documents, buckets, folder, name)


def _bucketed(rows: DataFrame, path: str, buckets: int) -> tuple[DataFrame, str]:
    """Write rows bucketed by document and sorted by term, so that later grouping by document needs no shuffle
    and a scan for a few terms skips most pages."""
    spark, name = rows.sparkSession, f"tfidf_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "doc_id").sortBy("term").option("path", path).saveAsTable(name)
    return spark.table(name), name


def question_terms(questions: DataFrame, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(query_id, term, tf) of the questions; an empty question has no terms."""
    return term_counts(questions.where(F.col("query") != ""), "query_id", "query", stop_words)


def _asked_often(counts: DataFrame, rows: int) -> DataFrame:
    """Terms that hold more than 1/HOT_TERMS of the question terms; at most HOT_TERMS."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows / HOT_TERMS).select("term")


def question_weights(model: TfidfModel, counts: DataFrame, size: int) -> DataFrame:
    """(query_id, term, weight) from the term counts of the questions (``size``
    bytes); terms the collection lacks are ignored."""
    idf = model.idf.select("term", "idf")
    if size <= min(model.idf_bytes, BROADCAST_BYTES):
        known = idf.join(F.broadcast(counts), "term")
    else:
        known = lookup_join(
            counts, idf, "term", lookup_bytes=model.idf_bytes, hot=_asked_often(counts, size // ROW_BYTES),
            spread_by="query_id",
        )
    return unit_weights(known.withColumn("w", F.col("tf") * F.col("idf")), "query_id")


def best_k(scores: DataFrame, k: int) -> DataFrame:
    """Rank by score, higher document id first on a tie, and keep k per question."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(model: TfidfModel, questions: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k documents with a positive score.

    Cosine of unit vectors is the sum of products over shared terms. Scores are
    rounded before ranking so that equal texts tie exactly.
    """
    counts = question_terms(questions)
    size = measured_bytes(counts, "term")
    terms = question_weights(model, counts, size).withColumnRenamed("weight", "wq")
    if size <= BROADCAST_BYTES:
        return best_k(_block_scores(model, terms, k), k)
    if _few_pairs(model, counts, size // ROW_BYTES):
        sums = _partial_scores(model, terms, size)
    else:
        sums = _pruned_scores(model, terms, size, k)
    return best_k(sums.withColumn("score", F.round("score", SCORE_DIGITS)), k)


def _block_scores(model: TfidfModel, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score), rounded: the best k of each block of documents for every question.

    The question terms are few enough to broadcast. A document's weights of
    asked terms are gathered where its bucket lies; terms travel as numbers.
    """
    ship_package(terms.sparkSession)
    terms = cut_lineage(terms)
    numbers = cut_lineage(terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    blocks = max(1, -(-terms.select("query_id").distinct().count() // BLOCK_QUESTIONS))
    asked = (
        terms.join(F.broadcast(numbers), "term")
        .groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part"))
        .agg(F.collect_list(F.struct("query_id", "number", "wq")).alias("asked"))
    )
    types = {f.name: f.dataType.simpleString() for f in terms.schema.fields + model.weights.schema.fields}
    texts = (
        model.weights.join(F.broadcast(numbers), "term")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("number", "weight")).alias("held"))
        .mapInArrow(_blocks, f"docs array<struct<doc_id: {types['doc_id']}, held: array<struct<number: long, weight: double>>>>")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = texts.withColumn("part", every).join(F.broadcast(asked), "part")
    return met.select("docs", "asked").mapInArrow(
        _best_of_blocks(k), f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held) as rows of ``BLOCK_DOCUMENTS``."""
    for batch in batches:
        docs = pa.StructArray.from_arrays(batch.columns, names=["doc_id", "held"])
        for start in range(0, batch.num_rows, BLOCK_DOCUMENTS):
            some = docs.slice(start, BLOCK_DOCUMENTS)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(some)], pa.concat_arrays([some]))], ["docs"])


def _best_of_blocks(k: int):
    """Arrow function: (block of documents, block of questions) rows to the best k documents of every question."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, asked = batch.columns
            for at in range(batch.num_rows):
                query, doc, score = _best_pairs(docs[at].values, asked[at].values, k)
                yield pa.RecordBatch.from_arrays([query, doc, score], ["query_id", "doc_id", "score"])

    return best


def _best_pairs(docs: pa.StructArray, asked: pa.StructArray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Question, document and score of the best k documents with a shared term of every question."""
    ids, held = docs.flatten()
    queries = asked.field("query_id").dictionary_encode(null_encoding="encode")
    n = len(queries.dictionary)
    question = queries.indices.to_numpy(zero_copy_only=False)
    by_number = np.argsort(asked.field("number").to_numpy(), kind="stable")
    question, wq = question[by_number], asked.field("wq").to_numpy()[by_number]
    numbers, starts, askers = np.unique(asked.field("number").to_numpy()[by_number], return_index=True, return_counts=True)

    # the higher id has the higher place and wins a tie; null comes last
    place = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    ids, held = ids.take(pa.array(place)), held.take(pa.array(place))
    postings = held.flatten()
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(held).to_numpy())
    number, weight = postings.field("number").to_numpy(), postings.field("weight").to_numpy()
    at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
    known = numbers[at] == number
    row, weight, at = row[known], weight[known], at[known]

    # each posting meets the questions with its term; a group of postings at a time
    scores = np.zeros(len(ids) * n)
    products = np.cumsum(askers[at])
    cuts = np.searchsorted(products, np.arange(PRODUCTS, products[-1] if len(products) else 0, PRODUCTS), side="right")
    for group in np.split(np.arange(len(at)), cuts):
        times = askers[at[group]]
        first = np.cumsum(times) - times
        pair = np.repeat(starts[at[group]] - first, times) + np.arange(times.sum())
        cell = np.repeat(row[group] * n, times) + question[pair]
        scores += np.bincount(cell, np.repeat(weight[group], times) * wq[pair], len(scores))
    scores = scores.reshape(len(ids), n).T

    rounded = np.floor(scores * 10.0**SCORE_DIGITS + 0.5)
    key = np.where(scores > 0, rounded.astype(np.int64) * len(ids) + np.arange(len(ids)), -1)
    if len(ids) > k:
        top = np.argpartition(key, len(ids) - k, axis=1)[:, len(ids) - k :]
    else:
        top = np.broadcast_to(np.arange(len(ids)), key.shape)
    query, rank = np.nonzero(np.take_along_axis(key, top, axis=1) >= 0)
    doc = top[query, rank]
    return (
        queries.dictionary.take(pa.array(query)), ids.take(pa.array(doc)),
        pa.array(rounded[query, doc] / 10.0**SCORE_DIGITS),
    )


def _few_pairs(model: TfidfModel, counts: DataFrame, rows: int) -> bool:
    """Whether scoring every (question, document) pair with a shared term is
    affordable; ``rows`` is at least the number of term counts."""
    limit = DIRECT_PAIRS_PER_TASK * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows * model.documents <= limit:
        return True
    asked = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = asked.join(model.idf, "term").agg(F.sum(F.col("n") * F.col("df"))).first()[0]
    return (pairs or 0) <= limit


def _partial_scores(model: TfidfModel, terms: DataFrame, size: int) -> DataFrame:
    """(query_id, doc_id, score): sums of products over the given question terms."""
    weights = model.weights
    if size <= PUSHED_TERMS * ROW_BYTES:
        # at most PUSHED_TERMS terms
        weights = weights.where(F.col("term").isin([row.term for row in terms.select("term").distinct().collect()]))
    matched = lookup_join(
        weights, terms.select("query_id", "term", "wq"), "term", lookup_bytes=size,
        hot=model.hot_terms().select("term").unionByName(_asked_often(terms, size // ROW_BYTES)), spread_by="doc_id",
    )
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))


def _pruned_scores(model: TfidfModel, terms: DataFrame, size: int, k: int) -> DataFrame:
    """Scores of all documents that can be among the best k, found by score bounds.

    A term adds at most ``wq`` times its largest weight, and the k-th largest
    weight of any one term already guarantees k documents a score (the floor).
    Terms whose bounds together stay below the floor cannot bring a document in
    on their own, so only the other terms are matched with all their documents.
    Of those documents only the ones that can still reach the k-th best sum are
    completed. The margin covers rounding, so the ranking is that of full scoring.
    """
    asked = terms.select("term").distinct()
    by_weight = Window.partitionBy("term").orderBy(F.desc("weight"))
    largest = (
        lookup_join(
            model.weights.select("doc_id", "term", "weight"), asked, "term",
            lookup_bytes=size, hot=model.hot_terms(), spread_by="doc_id",
        )
        .withColumn("_place", F.row_number().over(by_weight))
        .where(F.col("_place") <= k)
        .groupBy("term")
        .agg(F.max("weight").alias("top"), F.when(F.count(F.lit(1)) == k, F.min("weight")).otherwise(0.0).alias("kth"))
    )
    question = Window.partitionBy("query_id")
    rising = question.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = (
        terms.join(largest, "term")
        .withColumns({"bound": F.col("wq") * F.col("top"), "floor": F.max(F.col("wq") * F.col("kth")).over(question)})
        .withColumn("upto", F.sum("bound").over(rising))
        .withColumn("leads", F.col("upto") >= F.col("floor") - MARGIN)
        .withColumn("spare", F.coalesce(F.max(F.when(~F.col("leads"), F.col("upto"))).over(question), F.lit(0.0)))
        .select("query_id", "term", "wq", "leads", "spare")
    )
    bounded = cut_lineage(bounded)
    spare = bounded.groupBy("query_id").agg(F.max("spare").alias("spare"))

    sums = _partial_scores(model, bounded.where("leads"), size)
    bar = best_k(sums, k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("bar")
    )
    # one row per question, so smaller than the terms
    reach = broadcast_if(cut_lineage(spare.join(bar, "query_id")), size)
    able = cut_lineage(
        sums.join(reach, "query_id")
        .where(F.col("score") + F.col("spare") >= F.col("bar") - MARGIN)
        .select("query_id", "doc_id", "score")
    )

    missing = able.select("query_id", "doc_id").join(bounded.where(~F.col("leads")), "query_id")
    missing = missing.select("query_id", "doc_id", "term", "wq")
    missing = broadcast_if(missing, measured_bytes(missing, "term"))
    rest = model.weights.join(missing, ["doc_id", "term"]).select(
        "query_id", "doc_id", (F.col("wq") * F.col("weight")).alias("score")
    )
    return able.unionByName(rest).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def search_filled(model: TfidfModel, questions: DataFrame, docs: DataFrame, k: int = 8, key: str = "id") -> DataFrame:
    """Like :func:`search`, but every question gets min(k, documents) rows:
    what is missing is filled with zero scores, highest document id first.

    A question has at most k - 1 matches when it needs filling, so the 2k
    highest ids always suffice.
    """
    found = search(model, questions, k)
    # at most k hits per question
    hits = found.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "score")).alias("_hits"))
    highest = docs.select(F.col(key).alias("doc_id")).orderBy(F.desc("doc_id")).limit(2 * k)
    ids = highest.agg(F.collect_list("doc_id")).scalar()
    hit_ids = F.coalesce(F.col("_hits.doc_id"), F.array().cast("array<long>"))
    fill = F.transform(F.array_except("_ids", hit_ids), lambda doc: F.struct(doc.alias("doc_id"), F.lit(0.0).alias("score")))
    rows = (
        questions.where(F.col("query") != "")
        .select("query_id")
        .join(hits, "query_id", "left")
        .withColumn("_ids", ids)
        .select("query_id", F.inline(F.when(F.col("_hits").isNull(), fill).otherwise(F.concat("_hits", fill))))
    )
    return best_k(rows, k)


def with_chunks(results: DataFrame, docs: DataFrame, result_rows: int, key: str = "id") -> DataFrame:
    """Attach answer text and source. The texts are read once and not shuffled
    as long as the results (``result_rows`` at most) are few enough to broadcast."""
    chunks = docs.select(F.col(key).alias("doc_id"), F.col("answer").alias("chunk"), "source")
    return chunks.join(broadcast_if(results, result_rows * ROW_BYTES), "doc_id")
