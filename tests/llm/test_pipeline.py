"""The pipeline's stages: columns, effects, and what they leave alone."""

import corpus_pipeline
import pyarrow as pa

from talkmill import session
from talkmill.llm import decontaminate, jaccard_join
from talkmill.sources.tables import table


def test_stages_over_the_small_tables(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "jaccard_join":
            left = jaccard_join.jaccard_join(docs).collect()
            assert all(r.doc_id == r.component_id for r in left)
        if name == "decontamination":
            assert decontaminate.find(docs, table(spark, data, "benchmark")).count() == 0
        if name in ("pii", "byte_bpe"):
            assert docs.count() == before.count()
        if name == "pii":
            assert docs.where("n_chars <> length(text)").count() == 0
            assert docs.where("text rlike '@mail[0-9].example.com'").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert docs.columns == ["doc_id", "n_tokens", "ids"]


def test_quality_stage_keeps_what_labels_call_good(spark, data):
    kept = corpus_pipeline.quality(spark, table(spark, data, "documents"), data).select("doc_id")
    labels = table(spark, data, "labels")
    good = labels.where("quality = 1")
    assert good.join(kept, "doc_id").count() > 0.97 * good.count()
    bad = labels.where("quality = 0")
    assert bad.join(kept, "doc_id").count() < 0.1 * bad.count()


def batch_bytes(spark):
    """The sizes of the Arrow batches that 2,000 texts of 10,000 characters and one of 6 million reach a worker in."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["b", "n"])

    rows = spark.range(0, 2001, 1, 1).selectExpr("repeat('some text ', if(id = 2000, 600000, 1000)) text")
    return [(row.b, row.n) for row in rows.mapInArrow(sizes, "b long, n long").collect()]


def test_stages_hand_workers_small_batches(spark, data):
    docs = table(spark, data, "documents").limit(50)
    for name, stage in corpus_pipeline.STAGES:
        if name == "pii":  # without Arrow functions
            continue
        spark.conf.unset(session.ARROW_BYTES)
        stage(spark, docs, data)
        found = batch_bytes(spark)
        assert sum(n for _, n in found) == 2001, name
        sizes = sorted(b for b, _ in found)
        assert sizes[-2] < 1.1 * session.BATCH_BYTES and sizes[-1] < 1.1 * session.BATCH_BYTES + 6_000_000, name


def test_a_size_of_the_session_stays(spark):
    spark.conf.set(session.ARROW_BYTES, str(1 << 20))
    try:
        session.small_batches(spark)
        assert spark.conf.get(session.ARROW_BYTES) == str(1 << 20)
    finally:
        spark.conf.unset(session.ARROW_BYTES)
