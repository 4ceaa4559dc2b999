"""Text expressions: Column in, Column out, all inside code generation but for NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``\s`` has it, in a class that Java's and DuckDB's engines read alike.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The punctuation that scoring ignores, and the form of an annotation tag.
PUNCTUATION = r"[.,?!;:\"'()\[\]{}\\/—\-]"
TAG = r"\[[a-zA-Z_ ]+\]"
# Double-encoded letters and what they stand for.
DOUBLE_ENCODED = (("Å©", "ũ"), ("Ä©", "ĩ"), ("Å¨", "Ũ"), ("Ä¨", "Ĩ"), ("â€™", "'"))
#: What a tokenizer writes for a letter it does not know.
UNKNOWN = "⁇"


def collapse(t: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def normalize(t: Column) -> Column:
    """Form in which scores compare texts: null as empty, lower case, punctuation as blanks, blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), PUNCTUATION, " "))


def strip_tags(t: Column) -> Column:
    """Without annotation tags such as ``[pause]``."""
    return collapse(F.regexp_replace(t, TAG, " "))


def has_tag(t: Column) -> Column:
    return t.rlike(TAG)


def words(t: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(collapse(t), " "), lambda w: w != "")


@F.pandas_udf(T.StringType())
def nfkc(t: pd.Series) -> pd.Series:
    """NFKC form; ASCII texts are passed on as they are."""
    return t.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def repair_pairs(t: Column) -> Column:
    """The double-encoded letters put right, in one application."""
    for wrong, right in DOUBLE_ENCODED:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


def fix_double_encoding(t: Column) -> Column:
    """Repair first, NFKC after: NFKC would break the pairs with U+00A8 apart."""
    return nfkc(repair_pairs(t))


def clean_prediction(t: Column, mode: str = "intended") -> Column:
    """A recognizer's output with unknown tokens turned back into letters.

    ``intended`` reconstructs the letters and normalizes last; ``as_written`` normalizes first, as is published, which
    makes every later step but the collapsing idle. Null gives an empty text in both.
    """
    t = F.coalesce(t, F.lit(""))
    if mode == "as_written":
        return collapse(nfkc(t))
    if mode != "intended":
        raise ValueError(f"unknown mode {mode!r}")
    t = F.replace(t, F.lit(DOUBLE_ENCODED[4][0]), F.lit("'"))
    for base, upper, lower in (("Å", "Ũ", "ũ"), ("Ä", "Ĩ", "ĩ")):
        unknown = f"{base}{SPACE}*{UNKNOWN}{SPACE}*"
        t = F.regexp_replace(t, rf"(\A|[.!?]{SPACE}*){unknown}", "$1" + upper)
        t = F.regexp_replace(t, unknown, lower)
    return collapse(nfkc(F.replace(t, F.lit(UNKNOWN), F.lit(""))))


def _symbols(tokens: Column, vocabulary: Column) -> Column:
    """Tokens as one code point each, by their place in a vocabulary; surrogates are passed over, so there is room for over a million different tokens."""

    def one(w):
        place = F.array_position(vocabulary, w) + 0x4E00
        return F.decode(F.unhex(F.lpad(F.hex(F.when(place < 0xD800, place).otherwise(place + 0x800)), 8, "0")), "UTF-32")

    return F.array_join(F.transform(tokens, one), "")


def token_edits(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance of two token arrays: tokens become characters, and the built-in distance does the rest."""
    vocabulary = F.array_distinct(F.concat(ref, hyp))
    return F.when(ref == hyp, F.lit(0)).otherwise(F.levenshtein(_symbols(ref, vocabulary), _symbols(hyp, vocabulary))).cast("bigint")


def letter_edits(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.when(ref == hyp, F.lit(0)).otherwise(F.levenshtein(ref, hyp)).cast("bigint")
