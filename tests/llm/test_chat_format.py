"""Formatting conversations and reading them back."""

import random

from pyspark.sql import functions as F

from talkmill.llm.chat_format import format_chats, read_loss, read_turns

MARKS = ["<|im_start|>", "<|im_end|>", "<|im_next|>", "\\", "<|", "<\\|", "|", "\n", "\\n", "a", "é", "😀", " ", "assistant"]


def run(spark, rows):
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted int")
    formatted = format_chats(conversations)
    read = formatted.select(
        "conv_id", "formatted", "loss_spans", read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return {r.conv_id: r for r in read.collect()}


def test_every_turn_comes_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "", "a\\nb\nc\\", "<|x"])
            text = "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, role, text, None, 1))
    got = run(spark, rows)
    for conv in range(120):
        wanted = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == wanted
        assert got[conv].loss == "".join(text for role, text in wanted if role == "assistant")


def test_neighbours_of_one_role_are_one_message(spark):
    got = run(spark, [(1, 0, "user", "a", None, 1), (1, 1, "user", "b", None, 1), (1, 2, "assistant", "c", None, 1)])[1]
    assert got.formatted == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss_spans] == ["c"]


def test_nulls_ties_and_repeats_have_one_order(spark):
    rows = [(1, None, None, None, None, 1), (1, 0, "user", "b", None, 1), (1, 0, "user", "a", None, 1),
            (1, 0, "user", "a", None, 1), (None, 3, "assistant", "x", None, 1)]
    got = run(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].loss == "x" and run(spark, rows[::-1])[1].formatted == got[1].formatted
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(empty).count() == 0
