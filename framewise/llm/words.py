"""Words and lines of a text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space that ends a word
SPACE_CHARS = "\t\n\u000b\u000c\r "
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def trimmed(text: Column) -> Column:
    """``text`` without white space at its ends; '' for NULL."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words_of_trimmed(text: Column) -> Column:
    """Words of a column made by :func:`trimmed`."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE_RUN))


def count_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
