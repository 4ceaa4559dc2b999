"""Text forms shared by the operators: look-alike tables and the *same sentence* key."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and how the same shape is written in Latin.
CYRILLIC_AS_LATIN = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X",
}
GREEK_AS_LATIN = {
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ό": "ó", "ί": "í", "ά": "á", "ϲ": "c", "ϳ": "j",
}
ARMENIAN_AS_LATIN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S"}
CHEROKEE_AS_LATIN = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Latin letters that differ from the ASCII letter in code point only.
LATIN_AS_ASCII = {"ɡ": "g", "ɑ": "a", "ı": "i", "ſ": "s", "ⅼ": "l", "ꓲ": "I"}
# Signs written in place of the ASCII apostrophe, hyphen and full stops.
APOSTROPHES = "’‘‛ʼʻʽˈˊʹꞌꞋ′‵`´＇՚ʾʿ"
HYPHENS = "‐‑⁃˗"
CROSS_SCRIPT = CYRILLIC_AS_LATIN | GREEK_AS_LATIN | ARMENIAN_AS_LATIN | CHEROKEE_AS_LATIN

_SPACES = "".join(chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
_TAG = re.compile(r"\[[^\[\]]*\]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏɐ-ʯḀ-ỿ]")
_CROSS = str.maketrans({**CROSS_SCRIPT, **LATIN_AS_ASCII})
_OTHER_SCRIPT = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯԱ-֏Ꭰ-ᏽ]")
_ASCII_DROP = re.compile(r"[^a-z0-9 \t\r\n\x0b\x0c]+")
_DROP = regex.compile(r"[^\p{L}\p{M}\p{N} \t\r\n\x0b\x0c]+")
# invisible characters and apostrophes go, spaces of any kind become blanks, Latin look-alikes become ASCII
_FIRST = {c: None for c in _INVISIBLE} | {ord(c): None for c in APOSTROPHES} | {ord(c): " " for c in _SPACES} | {ord(c): a for c, a in LATIN_AS_ASCII.items()}


def _unscript(word: str) -> str:
    """Cross-script look-alikes of one word in Latin, if the word has Latin letters or nothing but look-alikes."""
    if not _OTHER_SCRIPT.search(word):
        return word
    letters = [c for c in word if c.isalpha()]
    if _LATIN.search(word) or all(c in CROSS_SCRIPT for c in letters):
        return word.translate(_CROSS)
    return word


def sentence_words(text: str | None) -> list[str]:
    """Words of a text as the *same sentence* rule compares them.

    Case, punctuation, apostrophes, signs, tags in square brackets, spacing and differences that cannot be
    seen are gone; letters, accents and digits stay. A null or blank text has no words.
    """
    if not text:
        return []
    t = _TAG.sub(" ", text) if "[" in text else text
    if t.isascii():
        return _ASCII_DROP.sub("", t.lower()).split()
    t = _DROP.sub("", t.translate(_FIRST))
    if not unicodedata.is_normalized("NFKC", t):
        t = _DROP.sub("", unicodedata.normalize("NFKC", t))
    if _OTHER_SCRIPT.search(t):
        t = " ".join(map(_unscript, t.split()))
    low = t.lower()
    return (low if unicodedata.is_normalized("NFC", low) else unicodedata.normalize("NFC", low)).split()


def sentence_key(text: str | None) -> str:
    return " ".join(sentence_words(text))


@F.pandas_udf(T.StringType())
def sentence_key_udf(s: pd.Series) -> pd.Series:
    return s.map(sentence_key)
