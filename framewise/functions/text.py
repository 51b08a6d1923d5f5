"""Text functions, on native expressions wherever Spark has them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# CJK blocks whose characters count as words of their own.
CJK_BLOCKS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
# Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column, separators: str = r"\s+") -> Column:
    """Pieces between separators, empty ones dropped."""
    return F.filter(F.split(text, separators), lambda w: w != "")


def doc_tokens(text: Column) -> Column:
    """Split on space, tab, CR, LF and the narrow no-break space."""
    return words(text, r"[ \t\r\n\x{202F}]+")


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Precomposed letters and the base letters they decompose to."""
    accented, base = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        left = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(left) == 1 and left[0] != ch:
            accented.append(ch)
            base.append(left[0])
    return "".join(accented), "".join(base)


def _decompose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


# characters that decompose to several letters, or lie beyond the letters table
_COMPOSED = "[\\x{AC00}-\\x{D7A3}\\x{10000}-\\x{10FFFF}]"


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without its non-spacing marks.

    A letter table does nearly all text inside the JVM; only rows with characters
    it cannot hold go through Python.
    """
    hard = text.rlike(_COMPOSED)
    decompose = F.pandas_udf(_decompose, StringType())
    full = F.coalesce(decompose(F.when(hard, text)), text)
    return F.regexp_replace(F.translate(full, *_plain_letters()), r"\p{Mn}+", "")


def basic_tokenize(text: Column, lower: bool = True) -> Column:
    """Words and single punctuation marks of cleaned text."""
    cjk = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_BLOCKS)
    t = F.regexp_replace(text, r"[\p{C}\x{FFFD}&&[^\t\n\r]]", "")
    t = F.regexp_replace(t, r"[\t\n\r\p{Zs}]", " ")
    t = F.regexp_replace(t, f"([{cjk}])", " $1 ")
    if lower:
        t = strip_accents(F.lower(t))
    t = F.regexp_replace(t, r"([!-/:-@\[-`{-~\p{P}])", " $1 ")
    return words(t, r"[\s\x{2028}\x{2029}]+")


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation, articles and extra spaces."""
    t = F.translate(F.lower(text), PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_subwords(text: Column) -> Column:
    """Tokens of a line with its ``@@ `` joins removed."""
    return words(F.replace(text, F.lit("@@ "), F.lit("")))
