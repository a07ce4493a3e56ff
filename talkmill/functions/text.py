"""Plain text helpers.

Whole words are runs of ``[\\p{L}\\p{N}_]``; ``\\b`` is avoided because its
meaning for non-ASCII letters differs between regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.stopwords import ENGLISH_STOP_WORDS

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
BLANK = r"[\s\p{Z}]"
# The characters Unicode-aware string libraries strip.
WHITESPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove surrounding whitespace of every kind, line ends included."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """All whole words of the lowered text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """Words of at least two characters without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda token: ~token.isin(*stop_words)) if stop_words else found


def normalised(text: Column) -> Column:
    """Lowered, stripped, inner whitespace squeezed: the key for equal questions."""
    return F.lower(F.regexp_replace(strip(text), f"{BLANK}+", " "))


def iso_utc(stamp: Column) -> Column:
    """ISO-8601 text of a UTC timestamp; microseconds only when there are any."""
    micros = F.date_format(stamp, "SSSSSS")
    base = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(
        stamp.isNotNull(),
        F.concat(base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")),
    )


def preview(text: Column, length: int = 50) -> Column:
    return F.substring(text, 1, length)


def preview_with_ellipsis(text: Column, length: int = 100) -> Column:
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, "...").otherwise(""))


def kilobytes(size_bytes: Column) -> Column:
    """Bytes in KB, two digits, halves to even."""
    return F.bround(size_bytes / F.lit(1024.0), 2)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, cut towards zero."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / 1000).cast("long")


def normalise_sender(sender: Column, suffix: str = "@c.us") -> Column:
    """Phone number of a sender address: the first suffix is removed."""
    position = F.instr(sender, suffix)
    return F.when(
        position > 0,
        F.concat(F.substring(sender, F.lit(1), position - 1), F.substring(sender, position + len(suffix), F.length(sender))),
    ).otherwise(sender)


def display_name(push_name: Column, contact_name: Column, sender: Column) -> Column:
    """First non-empty of push name, contact name and sender address."""
    return F.coalesce(F.nullif(push_name, F.lit("")), F.nullif(contact_name, F.lit("")), sender)
