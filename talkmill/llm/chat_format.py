"""Chat formatting: conversations as one marked string each, in column expressions only.

The turns of a conversation are collected as structs, sorted, neighbours with
the same role are merged into one message by an array aggregation, and the
messages are concatenated:

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>

``<|im_next|>`` stands between the texts of merged turns, so that every turn can
be read back. Texts cannot contain a mark: a backslash is doubled and ``<|`` is
written ``<\\|``. Roles are written the same way, and their line ends as ``\\n``.

Turns are sorted by (turn, role, text), null turns first, so ties and repeated
rows have one order. A null text or role is empty. Rows without conv_id form one
conversation with a null id. A conversation is one row of the result, so the
task that writes it holds its text; nothing else is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import let, take_columns

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text without marks."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a lone \n is a line end; in \\n the first two characters are a backslash
    return unescape(F.regexp_replace(role, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n"))


def _messages(turns: Column) -> Column:
    """Sorted turns to messages (role, texts): neighbours of one role are one message."""

    def begins(turn: Column, i: Column) -> Column:
        return (i == 0) | (turn["role"] != F.get(turns, i - 1)["role"])

    starts = F.array_compact(F.transform(turns, lambda turn, i: F.when(begins(turn, i), i)))

    def cut(at: Column) -> Column:
        return F.transform(
            at,
            lambda start, k: let(
                F.slice(turns, start + 1, F.coalesce(F.get(at, k + 1), F.size(turns)) - start),
                lambda part: F.struct(
                    F.get(part, 0)["role"].alias("role"),
                    F.transform(part, lambda turn: turn["text"]).alias("texts"),
                ),
            ),
        )

    return let(starts, cut)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of conversations (conv_id, turn, role, text).

    ``loss_spans`` holds (start, length) in code points of every text of an
    assistant turn in ``formatted``, in order.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = (
        take_columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    pieces = let(
        F.col("turns"),
        lambda turns: F.flatten(
            F.transform(
                _messages(turns),
                lambda m: F.concat(
                    F.array(
                        F.struct(
                            F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n")).alias("piece"),
                            F.lit(False).alias("loss"),
                        )
                    ),
                    F.flatten(
                        F.transform(
                            m["texts"],
                            lambda text, i: F.array(
                                F.struct(escape(text).alias("piece"), (m["role"] == TRAINED_ROLE).alias("loss")),
                                F.struct(
                                    F.when(i + 1 < F.size(m["texts"]), F.lit(NEXT)).otherwise(F.lit(END)).alias("piece"),
                                    F.lit(False).alias("loss"),
                                ),
                            ),
                        )
                    ),
                ),
            )
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(state: Column, p: Column) -> Column:
        size = F.length(p["piece"])
        span = F.struct(state["at"].alias("start"), size.alias("length"))
        return F.struct(
            (state["at"] + size).alias("at"),
            F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return grouped.select("conv_id", pieces.alias("pieces")).select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate("pieces", start, walk)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string was made from."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")

    def turns(block: Column) -> Column:
        head = F.length(F.lit(START))
        line = F.instr(block, "\n")
        role = _unescape_role(F.substring(block, head + 1, line - head - 1))
        texts = F.split(F.substr(block, line + 1), r"<\|im_next\|>")
        return F.transform(texts, lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    # the last part, after the final end mark, is empty
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(cut, "")
