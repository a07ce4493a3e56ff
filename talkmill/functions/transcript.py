"""Reading the replies of a speech-to-text model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.codes import LANGUAGE_NAMES_LONG
from talkmill.functions.language import detect_language_simple
from talkmill.functions.text import strip

# Fixed values.
LANGUAGE_MARK = "LANGUAGE:"
TEXT_MARK = "TRANSCRIPTION:"
FAILED = "TRANSCRIPTION_FAILED"
UNCLEAR = "Could not transcribe audio clearly"


def _code(part):
    """Exact code, else the first code that occurs inside the text, else null."""
    code = F.when(part.isin(*LANGUAGE_NAMES_LONG), part)
    for known in LANGUAGE_NAMES_LONG:
        code = code.when(F.contains(part, F.lit(known)), F.lit(known))
    return code


def parse_transcript(replies: DataFrame, reply: str = "reply", given: str | None = None) -> DataFrame:
    """Add ``text``, ``language`` and ``error`` read from a marked-up reply.

    Where the column ``given`` names a language, the model was asked for that
    one and the whole reply is the text.

    The last usable line of each kind wins. A reply without transcription line
    is taken whole and its language found by the simple rule.
    """
    lines = F.transform(F.split(F.col("_reply"), "\n"), strip)
    language_lines = F.filter("_lines", lambda line: F.startswith(line, F.lit(LANGUAGE_MARK)))
    text_lines = F.filter("_lines", lambda line: F.startswith(line, F.lit(TEXT_MARK)))
    codes = F.filter(
        F.transform(
            language_lines, lambda line: _code(F.lower(strip(F.replace(line, F.lit(LANGUAGE_MARK), F.lit("")))))
        ),
        lambda code: code.isNotNull(),
    )
    last_text = F.try_element_at(
        F.transform(text_lines, lambda line: strip(F.replace(line, F.lit(TEXT_MARK), F.lit("")))), F.lit(-1)
    )
    asked = F.coalesce(F.col(given), F.lit("")) != "" if given else F.lit(False)
    unmarked = asked | (F.coalesce(F.col("_marked"), F.lit("")) == "")
    failed = (F.col("_text") == "") | (F.col("_text") == FAILED)
    parsed = (
        replies.withColumn("_reply", strip(F.coalesce(F.col(reply), F.lit(""))))
        .withColumn("_lines", lines)
        .withColumns({"_marked": last_text, "_code": F.try_element_at(codes, F.lit(-1))})
        .withColumns(
            {
                "_text": F.when(unmarked, F.col("_reply")).otherwise(F.col("_marked")),
                # the simple rule only has to read replies without a transcription line
                "_unmarked": F.when(unmarked, F.col("_reply")),
            }
        )
    )
    return (
        detect_language_simple(parsed, "_unmarked", "_guess")
        .withColumns(
            {
                "text": F.when(failed, "").otherwise(F.col("_text")),
                "language": F.when(asked, F.col(given) if given else F.lit(None)).when(unmarked, F.col("_guess")).otherwise(F.coalesce("_code", F.lit("en"))),
                "error": F.when(failed, F.lit(UNCLEAR)),
            }
        )
        .drop("_reply", "_lines", "_marked", "_code", "_text", "_unmarked", "_guess")
    )
