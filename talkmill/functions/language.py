"""Language identification from word and letter lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import WORD, strip

# Letters, common words and farming terms per language, in tie order.
# A word listed twice counts twice.
LETTERS = {
    "tw": ["ɔ", "ɛ", "ŋ"],
    "ga": ["ɛ", "ɔ", "ŋ"],
    "ee": ["ɖ", "ɛ", "ɔ", "ŋ", "ʋ"],
    "dag": ["ŋ", "ɣ"],
}
COMMON_WORDS = {
    "tw": [
        "yɛ", "wo", "na", "ne", "aka", "adɛn", "ɛte", "sɛn", "dɛn", "mepaakyɛw", "medaase", "ɛyɛ", "deɛ", "nhwɛ",
        "ɔkasa", "kasa", "aboa", "afuom", "nsuo", "kuayɛ", "mfuo", "atɔ", "tɔn", "mepawo", "wo ho te sɛn", "ma me",
        "sɛdeɛ", "yɛbɛyɛ", "waye", "ɔyɛ", "ɔde", "ɔbɛ", "ɔrepe", "ɔmpɛ",
    ],
    "ga": [
        "ni", "ke", "tsɛ", "le", "kɛ", "mli", "shwɛ", "mi", "ni", "ɔyɛ", "he", "kome", "nitsumɔ", "oyiwala", "afɛmɔ",
        "yao",
    ],
    "ee": ["nye", "wò", "ɖe", "le", "na", "ŋu", "wo", "be", "ɖi", "mía", "esia", "akpɔ", "di", "vu", "ɖo"],
    "dag": ["n", "ka", "be", "ni", "ti", "di", "la", "bi", "o", "a", "daa", "paa", "yɛ", "kum", "nam", "buɣu"],
}
FARM_TERMS = {
    "tw": [
        "afuom", "kuayɛ", "mfuo", "aboa", "nnɔbae", "abɔdeɛ", "aburo", "aburoo", "bankye", "bayerɛ", "nkruma", "mako",
    ],
}
LETTER_WEIGHT, WORD_WEIGHT, FARM_WEIGHT = 0.3, 0.15, 0.2
MIN_LENGTH, SHORT_TEXT_CONFIDENCE = 3, 0.5
THRESHOLD, DEFAULT_CONFIDENCE = 0.1, 0.3
CONFIDENT = 0.6

# The short lists of the simple rule, in tie order.
SIMPLE_TWI_LETTERS = ["ɔ", "ɛ", "ŋ"]
SIMPLE_WORDS = {
    "tw": ["yɛ", "wo", "na", "ne", "aka", "adɛn", "ɛte", "sɛn", "dɛn", "mepaakyɛw"],
    "ga": ["ni", "ke", "tsɛ", "le", "kɛ", "mli", "shwɛ"],
    "ee": ["nye", "wò", "ɖe", "le", "na", "ŋu", "wo"],
    "dag": ["n", "ka", "be", "ni", "ti", "di", "la"],
}
SIMPLE_MIN_HITS = 2


def _literals(entries: list[str]) -> Column:
    return F.array(*[F.lit(entry) for entry in entries])


def _word_hits(text: Column, word_set: Column, entries: list[str]) -> Column:
    """How many entries occur as whole words; ``word_set`` holds the text's words."""
    single = [entry for entry in entries if " " not in entry]
    once = list(dict.fromkeys(single))
    repeated = [entry for entry in once if single.count(entry) > 1]
    phrases = [entry for entry in entries if " " in entry]
    hits = F.size(F.array_intersect(word_set, _literals(once)))
    for entry in repeated:
        hits = hits + F.array_contains(word_set, entry).cast("int") * (single.count(entry) - 1)
    for phrase in phrases:
        # contains() first: it is cheap and nearly always false
        found = F.contains(text, F.lit(phrase)) & text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){phrase}($|[^\p{{L}}\p{{N}}_])")
        hits = hits + found.cast("int")
    return hits


def _letter_hits(text: Column, letters: list[str]) -> Column:
    hits = F.lit(0)
    for letter in letters:
        hits = hits + F.contains(text, F.lit(letter)).cast("int")
    return hits


def detect_language(df: DataFrame, text: str, language: str = "language", confidence: str = "confidence") -> DataFrame:
    """Add the detected language and its confidence.

    Each language scores 0.3 per listed letter, 0.15 per listed word and 0.2
    per farming term that occurs, capped at 1. The highest score above 0.1
    wins, earlier language first on a tie; otherwise English.
    """
    listed = [word for lists in (COMMON_WORDS, FARM_TERMS) for entries in lists.values() for word in entries]
    # One pass over the text's words keeps the few that are in any list.
    scored = df.withColumn("_lowered", strip(F.lower(F.coalesce(F.col(text), F.lit(""))))).withColumn(
        "_words",
        F.array_intersect(
            F.regexp_extract_all("_lowered", F.lit(WORD), F.lit(0)), _literals(list(dict.fromkeys(listed)))
        ),
    )
    lowered, word_set = F.col("_lowered"), F.col("_words")
    scores = {}
    for code in LETTERS:
        score = _letter_hits(lowered, LETTERS[code]).cast("double") * F.lit(LETTER_WEIGHT)
        score = score + _word_hits(lowered, word_set, COMMON_WORDS[code]).cast("double") * F.lit(WORD_WEIGHT)
        if code in FARM_TERMS:
            score = score + _word_hits(lowered, word_set, FARM_TERMS[code]).cast("double") * F.lit(FARM_WEIGHT)
        scores[code] = F.least(score, F.lit(1.0))
    scored = scored.withColumns({f"_score_{code}": score for code, score in scores.items()})
    scored = scored.withColumn("_best", F.greatest(*[F.col(f"_score_{code}") for code in scores]))

    short = F.length(lowered) < MIN_LENGTH
    winner = F.when(short | (F.col("_best") <= THRESHOLD), F.lit("en"))
    for code in scores:
        winner = winner.when(F.col(f"_score_{code}") == F.col("_best"), F.lit(code))
    sureness = (
        F.when(short, F.lit(SHORT_TEXT_CONFIDENCE))
        .when(F.col("_best") <= THRESHOLD, F.lit(DEFAULT_CONFIDENCE))
        .otherwise(F.col("_best"))
    )
    return scored.withColumns({language: winner, confidence: sureness}).drop(
        "_lowered", "_words", "_best", *[f"_score_{code}" for code in scores]
    )


def detection_method(confidence: Column) -> Column:
    """Whether the patterns alone were sure enough or were only the fallback."""
    return F.when(confidence >= CONFIDENT, "pattern").otherwise("fallback")


def detect_language_simple(df: DataFrame, text: str, language: str = "language") -> DataFrame:
    """Add the language by substring counts; at least two hits are needed, Twi
    letters decide at once."""
    counted = df.withColumn("_lowered", F.lower(text)).withColumns(
        {f"_hits_{code}": _letter_hits(F.col("_lowered"), entries) for code, entries in SIMPLE_WORDS.items()}
    )
    counts = {code: F.col(f"_hits_{code}") for code in SIMPLE_WORDS}
    counted = counted.withColumn("_most", F.greatest(*counts.values()))
    has_letter = F.lit(False)
    for letter in SIMPLE_TWI_LETTERS:
        has_letter = has_letter | F.contains(F.col(text), F.lit(letter))
    winner = F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit("en")).when(has_letter, F.lit("tw"))
    winner = winner.when(F.col("_most") < SIMPLE_MIN_HITS, F.lit("en"))
    for code, count in counts.items():
        winner = winner.when(count == F.col("_most"), F.lit(code))
    return counted.withColumn(language, winner).drop("_lowered", "_most", *[f"_hits_{code}" for code in counts])
