"""Lookup tables with defaults: language codes, names and answer instructions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGE_NAMES_LONG = {"en": "English", "tw": "Twi (Akan)", "ga": "Ga", "ee": "Ewe", "dag": "Dagbani"}
LANGUAGE_NAMES = {"en": "English", "tw": "Twi", "ga": "Ga", "ee": "Ewe", "dag": "Dagbani"}
TO_EXTERNAL = {"en": "en", "tw": "ak", "ga": "gaa", "ee": "ee", "dag": "dag"}
FROM_EXTERNAL = {"en": "en", "ak": "tw", "tw": "tw", "gaa": "ga", "ee": "ee", "dag": "dag"}
LANGUAGE_INSTRUCTIONS = {
    "en": "Respond in English.",
    "tw": "Respond in Twi (Akan language). Use Twi vocabulary and grammar.",
    "ga": "Respond in Ga language. Use Ga vocabulary and grammar.",
    "ee": "Respond in Ewe language. Use Ewe vocabulary and grammar.",
    "dag": "Respond in Dagbani language. Use Dagbani vocabulary and grammar.",
}


def lookup(mapping: dict[str, str], key: Column, default: Column | str) -> Column:
    """``mapping.get(key, default)`` for a column; a null key takes the default."""
    literal = F.create_map(*[F.lit(part) for part in chain.from_iterable(mapping.items())])
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(literal, key), fallback)


def from_external(code: Column) -> Column:
    return lookup(FROM_EXTERNAL, code, "en")


def to_external(code: Column) -> Column:
    return lookup(TO_EXTERNAL, code, code)


def language_name(code: Column) -> Column:
    return lookup(LANGUAGE_NAMES, code, "Unknown")


def is_supported(code: Column) -> Column:
    return F.coalesce(code.isin(*LANGUAGE_NAMES_LONG), F.lit(False))
