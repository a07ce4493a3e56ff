"""Dashboard metrics over messages and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import normalised, tokens
from talkmill.operators.joins import ROW_BYTES, broadcast_if
from talkmill.session import cut_lineage


def messages_per_period(messages: DataFrame, ts: str = "created_at") -> DataFrame:
    """Messages per day, week (from Monday) and month.

    The log is counted per day; weeks and months are sums of days.
    """
    daily = messages.groupBy(F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), F.col("_day").alias("start")),
        F.struct(F.lit("week").alias("grain"), F.trunc("_day", "week").alias("start")),
        F.struct(F.lit("month").alias("grain"), F.trunc("_day", "month").alias("start")),
    )
    return (
        daily.select(F.inline(grains), "_n")
        .groupBy("grain", F.date_format("start", "yyyy-MM-dd").alias("period"))
        .agg(F.sum("_n").alias("messages"))
    )


def top_questions(questions: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The questions asked most often, spelling case and spacing aside.

    Questions are counted by digest. The texts of the questions with at least as
    many askers as the last one shown are looked up after that.
    """
    digest = F.sha2(normalised(F.col(text)), 256).alias("_digest")
    counts = questions.where(F.col(text).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("times_asked"))
    counts = cut_lineage(counts)
    last = counts.orderBy(F.desc("times_asked")).limit(limit).agg(F.min("times_asked")).first()[0]
    shown = counts.where(F.col("times_asked") >= F.lit(last or 0))
    asked = questions.select(digest, normalised(F.col(text)).alias("question"))
    named = asked.join(broadcast_if(shown, ROW_BYTES * 2 * shown.count()), "_digest")
    return (
        named.groupBy("_digest")
        .agg(F.first("question").alias("question"), F.first("times_asked").alias("times_asked"))
        .orderBy(F.desc("times_asked"), F.asc("question"))
        .limit(limit)
        .select("question", "times_asked")
    )


def top_questions_approx(questions: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The same from a sketch: one small state per task instead of one row per
    distinct question; counts of rare questions are estimates."""
    asked = questions.select(normalised(F.col(text)).alias("question"))
    top = asked.agg(F.expr(f"approx_top_k(question, {int(limit)})").alias("top"))
    return top.select(F.inline("top")).toDF("question", "times_asked")


def latency_stats(requests: DataFrame, timings: str = "timings_ms") -> DataFrame:
    """Count, mean, percentiles and maximum per stage.

    Values are counted per (stage, millisecond) first, so the exact percentiles
    work on one row per distinct duration however many requests there are.
    """
    histogram = (
        requests.select(F.explode(timings).alias("stage", "ms")).groupBy("stage", "ms").agg(F.count(F.lit(1)).alias("n"))
    )
    return histogram.groupBy("stage").agg(
        F.sum("n").alias("requests"),
        F.round(F.sum(F.col("ms").cast("long") * F.col("n")) / F.sum("n"), 6).alias("avg_ms"),
        F.percentile("ms", F.lit(0.5), F.col("n")).alias("p50_ms"),
        F.round(F.percentile("ms", F.lit(0.95), F.col("n")), 6).alias("p95_ms"),
        F.max("ms").cast("long").alias("max_ms"),
    )


def popular_terms(messages: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """In how many messages each dictionary term occurs.

    All tokens are counted first (one row per distinct token remains) and only
    then matched with the dictionary (column ``term``).
    """
    counts = (
        messages.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return counts.join(dictionary.select("term").distinct(), "term", "left_semi")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """The distinct tokens of a set of texts, as a dictionary."""
    return texts.select(F.explode(tokens(F.col(text))).alias("term")).distinct()


def crop_counts(users: DataFrame) -> DataFrame:
    """Users per crop."""
    return users.select(F.explode("crops").alias("crop")).groupBy("crop").agg(F.count(F.lit(1)).alias("users"))


def activity(messages: DataFrame, sender: str, ts: str, width: str = "5 minutes") -> DataFrame:
    """Messages and distinct senders per tumbling window."""
    per_sender = messages.groupBy(F.window(ts, width).alias("w"), F.col(sender)).agg(F.count(F.lit(1)).alias("n"))
    return per_sender.groupBy("w").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("active_senders")).select(
        F.col("w.start").alias("window_start"), "messages", "active_senders"
    )


def active_sliding(
    messages: DataFrame, user: str, ts: str, width: str = "24 hours", slide: str = "1 hour"
) -> DataFrame:
    """Distinct users per sliding window.

    A user's messages within one slide always share their windows, so they are
    reduced to one row per slide before being spread over the windows.
    """
    slots = messages.select(F.col(user).alias("u"), F.window(ts, slide).start.alias("slot")).distinct()
    return (
        slots.select("u", F.window("slot", width, slide).alias("w"))
        .distinct()
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("active_users"))
        .select(F.col("w.start").alias("window_start"), "active_users")
    )


def active_sliding_widths(
    messages: DataFrame, user: str, ts: str, widths: dict[str, int], slide_seconds: int = 3600
) -> DataFrame:
    """(width, window_start, active_users): distinct users per sliding window, for several widths at once.

    ``widths`` names each width and gives it as a number of slides. A window of w
    slides that begins at slot b sees a user who has a message in one of the slots
    b to b + w - 1, so a slot h covers the beginnings h - w + 1 to h. What the
    user's slot before already covers is taken off, and each slot adds one event
    where its own stretch begins and takes it off behind its end. A running
    sum over the events of a width is the number of users. The cost is that of
    a user's distinct slots, whatever the width; events are summed per slot
    before they are shuffled, and the running sum sees one row per slot of time.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    start = F.window(ts, f"{slide_seconds} seconds").start.cast("timestamp_ntz")
    slot = F.floor(F.timestamp_diff("SECOND", epoch, start) / slide_seconds).cast("long")
    slots = messages.where(F.col(ts).isNotNull()).select(F.col(user).alias("u"), slot.alias("slot")).distinct()
    before = F.lag("slot").over(Window.partitionBy("u").orderBy("slot"))
    named = F.array(*[F.struct(F.lit(name).alias("width"), F.lit(n).alias("n")) for name, n in widths.items()])
    events = (
        slots.where(F.col("u").isNotNull())
        .withColumn("before", before)
        .select("slot", "before", F.inline(named))
        .withColumn("from", F.greatest(F.col("slot") - F.col("n") + 1, F.col("before") + 1))
        .select(
            "width",
            F.inline(
                F.array(
                    F.struct(F.col("from").alias("slot"), F.lit(1).alias("step")),
                    F.struct((F.col("slot") + 1).alias("slot"), F.lit(-1).alias("step")),
                )
            ),
        )
    )
    steps = events.groupBy("width", "slot").agg(F.sum("step").alias("step"))
    in_time = Window.partitionBy("width").orderBy("slot")
    counts = steps.withColumns({"active_users": F.sum("step").over(in_time), "next": F.lead("slot").over(in_time)})
    # between two events nothing changes
    each = counts.where("active_users > 0").withColumn("slot", F.explode(F.sequence("slot", F.col("next") - 1)))
    begins = F.timestamp_add("SECOND", F.col("slot") * slide_seconds, epoch)
    return each.select("width", begins.alias("window_start"), "active_users")


# One file is one task: an export of more rows is a table, not a summary.
MAX_EXPORT_ROWS = 1_000_000


def export_csv(summary: DataFrame, path: str) -> None:
    """Write a small aggregate as one CSV file with header; a large one is an error."""
    if summary.limit(MAX_EXPORT_ROWS + 1).count() > MAX_EXPORT_ROWS:
        raise ValueError(f"a summary of more than {MAX_EXPORT_ROWS} rows is not exported as one file")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
