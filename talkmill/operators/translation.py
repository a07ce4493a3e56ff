"""Translation by lookup in a table of known translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.language import detect_language
from talkmill.operators.joins import broadcast_if, measured_bytes

# Confidence of a text that is English already, of a found
# translation with a given source language, and of a text left as it is.
ENGLISH_CONFIDENCE, FOUND_CONFIDENCE, MISSING_CONFIDENCE = 1.0, 0.8, 0.0


AUTO = "auto"


def _join_memory(texts: DataFrame, memory: DataFrame, text: str, language: str, to_english: bool) -> DataFrame:
    """Add ``translated`` from the memory, by digest of the text and language.

    Texts themselves are no join keys. The memory is broadcast when its measured
    bytes allow; otherwise a stock text that very many rows hold is a skewed side
    of the join, which adaptive execution splits.
    """
    of, other = ("source_lang", "target_lang") if to_english else ("target_lang", "source_lang")
    known = (
        memory.where(F.col(other) == "en")
        .groupBy(F.sha2("text", 256).alias("_digest"), F.col(of).alias("_language"))
        .agg(F.min("translated").alias("translated"))
    )
    known = broadcast_if(known, measured_bytes(known, "_digest", "translated"))
    same = (F.sha2(F.col(text), 256) == F.col("_digest")) & (F.col(language) == F.col("_language"))
    return texts.join(known, same, "left").drop("_digest", "_language")


def translate_to_english(
    texts: DataFrame, memory: DataFrame, text: str = "text", language: str = "source_lang", auto: bool = False
) -> DataFrame:
    """Add ``english``, ``translation_confidence`` and the language used.

    English text passes through, a known text is translated, anything else
    stays as it is. With ``auto`` a source language named "auto" is detected, and
    the confidence is that of the detection.
    """
    sure = F.lit(FOUND_CONFIDENCE)
    if auto:
        asked = F.col(language) == AUTO
        texts = detect_language(
            texts.withColumn("_asked", F.when(asked, F.col(text))), "_asked", "_detected", "_sure"
        ).withColumn("_auto", asked)
        texts = texts.withColumn(language, F.when(F.col("_auto"), F.col("_detected")).otherwise(F.col(language)))
        sure = F.when(F.col("_auto"), F.col("_sure")).otherwise(sure)
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    english = F.col(language) == "en"
    found = F.col("translated").isNotNull()
    of_english = F.when(F.col("_auto"), F.col("_sure")).otherwise(ENGLISH_CONFIDENCE) if auto else F.lit(ENGLISH_CONFIDENCE)
    return _join_memory(texts, memory, text, language, to_english=True).withColumns(
        {
            "english": F.when(empty, "").when(~english & found, F.col("translated")).otherwise(F.col(text)),
            "translation_confidence": F.when(empty, MISSING_CONFIDENCE)
            .when(english, of_english)
            .when(found, sure)
            .otherwise(MISSING_CONFIDENCE),
            language: F.when(empty, "en").otherwise(F.col(language)),
        }
    ).drop("translated", "_asked", "_detected", "_sure", "_auto")


def translate_from_english(texts: DataFrame, memory: DataFrame, text: str = "text", language: str = "target_lang") -> DataFrame:
    """Add ``local`` and ``translated_ok`` for English texts and their target language."""
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    use_memory = filled & (F.col(language) != "en") & F.col("translated").isNotNull()
    return _join_memory(texts, memory, text, language, to_english=False).withColumns(
        {
            "local": F.when(~filled, "").when(use_memory, F.col("translated")).otherwise(F.col(text)),
            "translated_ok": filled & ((F.col(language) == "en") | F.col("translated").isNotNull()),
        }
    ).drop("translated")


def bilingual(translated: DataFrame, text: str = "text", language: str = "target_lang", include_english: bool = True) -> DataFrame:
    """Add ``reply``: the translation with the English text in brackets after
    it, only the translation, or the English text when there is no translation."""
    pair = F.concat(F.col("local"), F.lit("\n\n[English: "), F.col(text), F.lit("]"))
    shown = pair if include_english else F.col("local")
    return translated.withColumn(
        "reply", F.when((F.col(language) != "en") & F.col("translated_ok"), shown).otherwise(F.col(text))
    )
