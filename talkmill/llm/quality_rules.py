"""Quality rules with host-level verdicts, in column expressions only.

Every document is measured once, inside its row. Rule failures are then summed
per host (``source``), each host's failure rate is shrunk towards the rate of all
hosts by a beta prior that is estimated from the hosts themselves, and hosts
whose shrunk rate is over a limit lose all their documents.

The measures go to a checkpoint (about a hundred bytes per document), because
both the host sums and the result need them; texts are not shuffled. Host sums
are combined before the shuffle, so a host with a third of all rows is one row
per task.

Defined results: a null text counts as empty, and an empty one fails ``short``;
documents without a source have no host verdict; equal rows each give a row;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import let, take_columns, words
from talkmill.operators.joins import broadcast_if, measured_bytes
from talkmill.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 3
# Hosts are judged by these failures; the first two also are the base rules.
RULES = ("short", "repetitive", "symbols", "copied_lines", "odd_words")


def _covered_by_repeats(w: Column) -> Column:
    """How many words lie in a window of three words that the text has more than once.

    Windows are compared by a 64-bit hash. They are sorted with their positions
    only when some window occurs twice.
    """

    def among(keys: Column) -> Column:
        paired = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            found = F.transform(
                s,
                lambda e, i: F.when(
                    F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False))
                    | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)),
                    e["p"],
                ),
            )
            return let(F.sort_array(F.array_compact(found)), union)

        def union(starts: Column) -> Column:
            steps = F.transform(
                starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(paired, twice))

    keys = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(keys, among))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and rule failures.

    ``docs``: doc_id, text, source. Columns: doc_id, source, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lines and one boolean per rule.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered_by_repeats(w).cast("long").alias("n_repeat_words"),
        ),
    )
    full = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = let(
        full,
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        ),
    )
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")
    counted = take_columns(docs, doc_id="doc_id", text="text", source="source").select(
        "doc_id", "source", of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols")
    ).select("doc_id", "source", "w.*", "l.*", "n_symbols")
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return counted.withColumns(
        {
            "short": n < 50,
            "repetitive": 100 * repeated > 50 * n,
            "symbols": 10 * F.col("n_symbols") > n,
            "copied_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
            "odd_words": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        }
    )


def host_rates(measures: DataFrame) -> DataFrame:
    """(source, n_docs, n_failed, rate): every host's failure rate under the estimated beta prior.

    The prior's mean is the share of failing documents, and its weight follows
    from how far the hosts' rates spread beyond what their sizes explain (method
    of moments), held between 2 and 1000 documents.
    """
    failed = F.greatest(*[F.col(rule) for rule in RULES])
    hosts = (
        measures.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    )
    share = F.col("n_failed") / F.col("n_docs")
    mean, spread, inverse = hosts.agg(
        F.sum("n_failed") / F.sum("n_docs"), F.var_pop(share), F.avg(1 / F.col("n_docs"))
    ).first()
    mean, spread, inverse = mean or 0.0, spread or 0.0, inverse or 1.0
    between = spread - mean * (1 - mean) * inverse
    weight = min(1000.0, max(2.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def quality_rules(docs: DataFrame, host_limit: float = 0.6) -> DataFrame:
    """Measures, base verdict and verdict of every document.

    ``docs``: doc_id, text, source. ``kept`` is false for a document that fails
    a base rule, another rule of its own, or whose host's shrunk failure rate is
    over ``host_limit``.
    """
    measures = cut_lineage(measure(docs))
    bad = host_rates(measures).where(F.col("rate") > host_limit).select("source", F.lit(True).alias("bad_host"))
    # a bad host's many documents are one skewed left side, which adaptive execution splits
    judged = measures.join(broadcast_if(bad, measured_bytes(bad, "source")), "source", "left")
    bad_host = F.coalesce("bad_host", F.lit(False))
    return judged.withColumns(
        {
            "base_failed": F.col("short") | F.col("repetitive"),
            "bad_host": bad_host,
            "kept": ~(F.greatest(*[F.col(rule) for rule in RULES]) | bad_host),
        }
    )
