"""Filter interaction audit: what each filter removes, in every order the filters can be applied in.

Removing documents is a cooperative game: the players are the filters, and a
coalition's value is the number of documents that at least one of its filters
removes. Two things follow from the 32 coalitions of a part alone:

* a step's counts are differences of coalitions: the filter with those before
  it, less those before it;
* Shapley values come from the Hart-Mas-Colell potential: ``P(none) = 0`` and
  ``|S| P(S) = v(S) + the sum of P(S without i)``. A filter's value is the
  potential of all filters less the potential without it. The potential is kept
  as a whole number, times 120, which every one of its denominators divides.

So documents are reduced to counts of (part, failed filters, labels) before any
order is looked at: the only shuffles are of one narrow row per distinct
document (digest, doc_id, mask), combined per task first, and of the labels.

The filters see whole texts; words are ``[^\\x20\\x09-\\x0D]+``, with case:

A fewer than 100 words; B distinct words fewer than 80 % of the words; C letters
A-Z more than 10 % of the code points; D one of ``#$%&*|``; E the text of a
smaller doc_id, in any part and removed or not.

Defined results: a null text is an empty one, which fails A only, and E if a
smaller doc_id has it too; a null language is the part ''; rows with one doc_id
and text are separate documents of which none precedes the other; a row without
doc_id never fails E, does not make others fail it and has no label; a document
with several label rows has a mark that any of them gives; an empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import let, take_columns, words

FILTERS = "ABCDE"
_BITS = {letter: 1 << k for k, letter in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1
# All orders of five filters; a multiple of every denominator of the potential.
ORDERS = ["".join(order) for order in permutations(FILTERS)]


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, _BITS[letter]).otherwise(0)


def failed(text: Column) -> Column:
    """The filters A to D that a text that is not null fails, as bits."""
    few_words = let(
        words(text),
        lambda w: _bit(F.size(w) < 100, "A") + _bit(F.size(F.array_distinct(w)) * 100 < F.size(w) * 80, "B"),
    )
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        few_words + _bit(capitals * 100 > F.length(text) * 10, "C") + _bit(text.rlike("[#$%&*|]"), "D")
    ).cast("int")


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per labelled document."""
    rows = take_columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    mark = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    return rows.groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part by the filters they fail, as bits."""
    rows = take_columns(docs, doc_id="doc_id", text="text", lang="lang")
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "part": F.coalesce("lang", F.lit(""))})
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256)))
    # repeated rows become one before anything travels
    known = rows.select("doc_id", "part", digest.alias("digest"), failed(F.col("text")).alias("mask"))
    known = known.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = known.join(_marks(labels), "doc_id", "left").na.fill(False, ["good", "toxic"])
    # so do copies of one text, but for the first of them
    copies = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    original = F.when(F.col("digest").isNull(), F.col("n")).when(first, F.col("n_least")).otherwise(0)
    split = copies.withColumn("original", original).select(
        "part", "good", "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask"), F.col("original").alias("n")),
                F.struct((F.col("mask") + _BITS["E"]).alias("mask"), (F.col("n") - F.col("original")).alias("n")),
            )
        ),
    )
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def coalitions(counts: DataFrame) -> DataFrame:
    """(part, total, removed, good, toxic, only): arrays over all coalitions 0 to 31 of what each of them removes.

    ``only`` counts the documents that fail exactly the coalition's filters.
    """
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(_ALL))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    values = each.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"),
        count(hit).alias("removed"),
        count(hit & F.col("good")).alias("good"),
        count(hit & F.col("toxic")).alias("toxic"),
        count(F.col("mask") == F.col("coalition")).alias("only"),
    )
    # 32 rows of each part
    listed = values.groupBy("part").agg(
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("coalition", "removed", "good", "toxic", "only"))).alias("listed"),
    )
    return listed.select(
        "part", "total", *[F.col(f"listed.{name}").alias(name) for name in ("removed", "good", "toxic", "only")]
    )


def potential(values: Column) -> Column:
    """The game's potential of every coalition, times the number of orders, from its values."""

    def next_one(known: Column, coalition: Column) -> Column:
        total = F.get(values, coalition) * len(ORDERS)
        for bit in _BITS.values():
            without = F.get(known, coalition.bitwiseXOR(bit))
            total = total + F.when(coalition.bitwiseAND(bit) != 0, without).otherwise(0)
        # the division leaves no rest
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(coalition))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, of documents (doc_id, text, lang) and labels (doc_id, quality, toxic).

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley
    are counts; shapley is summed over all orders.
    """
    games = coalitions(failure_counts(docs, labels)).withColumn("potential", potential(F.col("removed")))
    steps = games.withColumn("filter_order", F.explode(F.array(*[F.lit(order) for order in ORDERS]))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = before = F.lit(0)
    for name, value in _BITS.items():
        bit = bit + F.when(letter == name, value).otherwise(0)
        before = before + F.when(F.instr("filter_order", name) < F.col("step"), value).otherwise(0)
    steps = steps.withColumns({"bit": bit, "before": before}).withColumn("after", F.col("bit") + F.col("before"))
    at = lambda values, coalition: F.get(F.col(values), F.col(coalition))
    gain = lambda values: at(values, "after") - at(values, "before")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - at("removed", "after")).alias("kept"),
        gain("removed").alias("removed"),
        (at("removed", "bit") - gain("removed")).alias("redundant"),
        at("only", "bit").alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(_ALL)) - F.get("potential", F.lit(_ALL) - F.col("bit"))).alias("shapley"),
    )
