"""Columns with the operators' own names, and repeated rows."""

from pyspark.sql import functions as F

from talkmill.llm import jaccard_join, pii, quality_gam

TAKEN = ("_base", "_spans", "_candidates", "_score", "_score_", "_node", "_of", "_keep", "_k", "_odd", "node", "row", "key", "component_id", "a.b")


def clashing(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", *[F.lit(f"own {name}").alias(name) for name in TAKEN])


def assert_kept(found):
    assert found.columns == ["doc_id", "text", *TAKEN]
    for row in found.collect():
        assert list(row)[2:] == [f"own {name}" for name in TAKEN]


def test_clashing_columns_stay(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words), (2, words + " more"), (2, "quite another text of some words"), (3, None), (4, "mail a@b.org"), (4, "mail a@b.org"), (None, words)]
    docs = clashing(spark, rows)
    redacted = pii.redact(docs)
    assert_kept(redacted)
    assert sorted(r.text for r in redacted.where("doc_id = 4").collect()) == ["mail [EMAIL]"] * 2
    left = jaccard_join.JaccardJoin(docs).one_of_each(docs)
    assert_kept(left)
    # repeated rows are one group, rows that share an id are judged by their texts, a row without id goes with its copy
    assert sorted((str(r.doc_id), r.text) for r in left.select("doc_id", "text").collect()) == sorted(
        [("1", words), ("2", "quite another text of some words"), ("3", None), ("4", "mail a@b.org")], key=str
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taught = clashing(spark, [(i, words if i % 2 else "# # $$ | " * 30) for i in range(40)])
    assert_kept(quality_gam.keep_good(taught, labels))


def test_obfuscated_address_with_a_long_local_part(spark):
    local = "x" * 90
    docs = spark.createDataFrame([(1, f"write to {local} [at] example [dot] org now")] + [(k, f"mail me{k} [at] site [dot] org") for k in range(2, 30)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.annotate(docs, pii.learn(docs)).select("doc_id", pii.listed(F.col("_spans")).alias("spans")).collect()}
    assert spans[1] == f"email:9:{9 + 90 + len(' [at] example [dot] org')}"
