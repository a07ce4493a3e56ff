"""Personal data: base spans against a plain rule by rule search, added spans, redaction, hostile texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from talkmill.llm import pii
from talkmill.llm.catalog import op6_pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
}


def base_spans(text):
    found = []
    for place, (kind, (pattern, right)) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text or ""):
            if right(m.group()):
                found.append((m.start(), place, kind, m.end()))
    return sorted(found)


def as_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def hostile(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "_d@e.fr", "x.", "@", "1.2.3.4", "999.1.2.3", "0001.2.3.4.5.6", " ", "-", "+", "4539 1488 0343 6467",
             "4539148803436467", "12345678901234567890123", "+1 (212) 555-0100", "(", ")", ".", "é", "😀", "\n", "7", "%"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


@pytest.fixture(scope="module")
def texts():
    long_run = ["7" * 30_000, "a" * 30_000 + "@", "a.b" * 8_000, "+1" + " 1" * 20_000, "1." * 20_000]
    return [None, "", *[hostile(s) for s in range(300)], *long_run]


def test_base_spans_are_those_of_the_rules(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _spans string")
    docs = docs.select("doc_id", "text")
    marked = pii.annotate(docs, pii.SpanModel()).select("doc_id", pii.listed(F.col("_base")), pii.listed(F.col("_spans")))
    for doc_id, base, spans in marked.collect():
        assert base == spans == as_text(base_spans(texts[doc_id])), texts[doc_id][:200]


def test_query_on_the_small_tables(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op6_pii(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(as_text(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in RULES]
        assert set(as_text(spans).split(",")) <= set(r.spans.split(",")) | {""}


def test_redaction_replaces_spans_and_keeps_the_rest(spark):
    text = 'mail é.x a.b@c.org, token = "0123456789abcdef0123" from 10.0.0.1 end'
    docs = spark.createDataFrame([(1, text, None), (2, None, None), (3, "plain", None)], "doc_id int, text string, n int")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[1].startswith("mail é.x [EMAIL], token = ") and got[1].endswith(" from [IP] end")
    assert got[2] is None and got[3] == "plain"


def test_estimation_finds_the_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        votes = tuple(rng.random() < (p if truth else 1 - p) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    chance, reliable = pii.expectation_maximisation(counts)
    assert reliable[0][0] > 0.9 and reliable[1][0] > 0.85 and 0.5 < reliable[2][0] < 0.7
    assert chance[(True, True, True)] > 0.95 > 0.05 > chance[(False, False, False)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.redact(docs).count() == 0


def test_a_long_secret_is_marked_to_its_end(spark):
    long = "aB3" * 200
    docs = spark.createDataFrame([(k, f"token={long} end") for k in range(3)], "doc_id long, text string")
    found = docs.select(F.explode(pii._candidates(F.col("text"))).alias("c")).select("c.kind", "c.start", "c.end").distinct()
    assert [tuple(row) for row in found.collect()] == [("secret", 6, 606)]
    assert {r.text for r in pii.redact(docs).collect()} == {"token=[SECRET] end"}


def redacted_plainly(text, spans):
    out, at = [], 0
    for start, _, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_texts_with_very_many_matches(spark):
    """100,000 matches of base rules and 30,000 candidates in one text, beside small ones: spans and redaction."""
    import time

    rng = random.Random(7)
    parts = ["a@b.c ", "é 1.2.3.4 ", "x@y.org, ", "+1 (212) 555-0100 😀", "password: Abcd1234efgh5678 ", "me [at] x.org ", "word\n"]
    many = "".join(rng.choice(parts) for _ in range(150_000))
    texts = [many, "", "none", *["".join(rng.choice(parts) for _ in range(n)) for n in (1, 2, 127, 128, 129, 400)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    marked = {r.doc_id: r for r in pii.annotate(docs, pii.learn(docs)).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - began < 90
    for k, text in enumerate(texts):
        base, spans = [tuple(s) for s in marked[k]["_base"]], [tuple(s) for s in marked[k]["_spans"]]
        assert base == base_spans(text)
        assert set(base) <= set(spans) and spans == sorted(spans)
        assert redacted[k] == redacted_plainly(text, spans)
    assert len(marked[0]["_base"]) > 80_000 and len(marked[0]["_spans"]) > len(marked[0]["_base"]) + 20_000


def test_added_spans_are_the_accepted_ones_beside_base_spans(spark):
    """Every accepted candidate that no base span touches, and no other, on texts where they touch often."""
    rng = random.Random(9)
    parts = ["password=", "a@b.c", "1.2.3.4", "+1 212 555 0100", "4539148803436467", " ", "token: ", "abcdefgh1234", "me(at)x.org", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.learn(docs)
    found = pii.annotate(docs, model).withColumn("c", F.filter(pii._candidates(F.col("text")), model.accepts)).collect()
    for row in found:
        base = [tuple(s) for s in row["_base"]]
        free = [tuple(c[:4]) for c in row["c"] if not any(b[0] < c[3] and c[0] < b[3] for b in base)]
        assert [tuple(s) for s in row["_spans"]] == sorted(base + free)
