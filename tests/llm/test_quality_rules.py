"""Document measures against plain code, and host verdicts."""

import random
import re

from talkmill.llm.quality_rules import host_rates, measure, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\n\nx\n x", "é😀 ## <| |>", "of " * 5000]
    texts += [
        "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "#", "é", "\u0085"]) for _ in range(rng.randint(0, 80)))
        for _ in range(150)
    ]
    rows = [(i, text, "h", "clash") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(texts)
    for doc_id, *counts in got:
        if doc_id != 9:
            assert tuple(counts) == plain(texts[doc_id]), repr(texts[doc_id])
    assert tuple(got[9])[1:] == (5000, 10000, 0, 0, 5000)


def test_hosts_that_mostly_fail_lose_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(200)]
    rows += [(1000 + i, good if i % 10 else "short", f"ok{i % 7}") for i in range(700)]
    rows += [(5000, good, None), (5001, None, None), (5002, "short", "tiny")] + [(5003, good, "tiny")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {(r.doc_id, r.kept, r.bad_host) for r in quality_rules(docs).collect()}
    assert (0, False, True) in kept and not any(k for i, k, _ in kept if i < 200)
    assert all((1000 + i, i % 10 != 0, False) in kept for i in range(700))
    assert (5000, True, False) in kept and (5001, False, False) in kept
    # two thirds of three documents are not enough against the prior
    assert (5003, True, False) in kept
    rates = {r.source: r.rate for r in host_rates(measure(docs)).collect()}
    assert rates["bad"] > 0.6 > rates["tiny"] > rates["ok0"] and None not in rates


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality_rules(docs).count() == 0
