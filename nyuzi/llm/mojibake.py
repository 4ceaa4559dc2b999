"""Text decoded with the wrong encoding: found and, where nothing is lost, restored.

Every distinct clean word of the corpus is put through every wrong-encoding chain; the garbled forms make a
table that the corpus' own tokens are hash-joined against. Words that stand nowhere clean are covered by the
same table at the grain of letters: the garbled forms of every distinct clean non-ASCII letter of the corpus and of
the common European ones, at most as many as letters in Unicode. A token is restored from letters only when one chain makes all its garbled
letters out of the ones put in their place; otherwise it is reported as lost.

Defined results: null and empty texts are never garbled; a text with U+FFFD, or with question marks in place of
letters inside its words, is garbled and lost there for good;
a token with several originals keeps the original under the shortest chain, then the alphabetically first; repeated
rows are judged alike; an empty table gives an empty result; other columns are untouched, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.session import cut

#: Single-byte encodings that UTF-8 bytes are wrongly read in.
WRONG_ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "cp1254", "iso8859-15")
#: Two wrong readings after each other: those of one family of machines.
TWICE = ("cp1252", "latin-1", "mac_roman", "cp850", "cp1250")
#: Signs that clean texts may hold whether or not this corpus does.
CLEAN_SIGNS = "‘’“”„«»‹›–—…©®°€£§±•·™\u00a0"
#: Letters of Western and Central Europe (Latin-1 and Extended-A): loan words and names bring them in, often in garbled form only.
COMMON_LETTERS = "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7))
#: Most letters that are sent to the executors; Unicode has fewer than 150,000 letters and signs.
MAX_LETTERS = 200_000


def _byte_table(encoding: str) -> list[str]:
    """Bytes as an encoding reads them; bytes it leaves undefined stay what they are, as browsers do it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TABLES = {e: _byte_table(e) for e in WRONG_ENCODINGS}
CHAINS: tuple[tuple[str, ...], ...] = tuple((e,) for e in WRONG_ENCODINGS) + tuple((a, b) for a in TWICE for b in TWICE)


def garble(text: str, chain: tuple[str, ...]) -> str:
    """``text`` written as UTF-8 and read in a wrong encoding, once for each step of the chain."""
    for encoding in chain:
        table = _TABLES[encoding]
        text = "".join(table[b] for b in text.encode("utf-8", "surrogatepass"))
    return text


def garbled_forms(text: str) -> dict[str, int]:
    """All forms of a text that differ from it, with the length of the shortest chain leading there."""
    out: dict[str, int] = {}
    for chain in CHAINS:
        form = garble(text, chain)
        if form != text and (form not in out or len(chain) < out[form]):
            out[form] = len(chain)
    return out


_CLEAN_LETTER = {"L", "M"}


def is_clean_word(word: str) -> bool:
    """Letters, accents and apostrophes only: no control, no sign and no number that a wrong reading brings in."""
    return all(c == "'" or c == "’" or (unicodedata.category(c)[0] in _CLEAN_LETTER and c not in "ªº") for c in word)


#: White space in ASCII only: wrong readings turn bytes into U+00A0 and U+0085, which belong to words.
SPLIT = r"[ \t\r\n\x0b\x0c]+"
#: ASCII punctuation at the ends of a token and, before it, characters nobody sees.
EDGES = r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$"
#: Letters that an encoder replaced by question marks: such a mark goes on in lower case, or stands between capitals.
LOST = r"�|\?+[\p{Ll}\p{M}]|\p{Lu}\?+\p{Lu}"
#: Tokens in which a question mark belongs, such as addresses.
ADDRESS = r"[/=&@]"
_HIDDEN = "[​-‍⁠﻿]"


def _core(token):
    """The part of a token that is compared: no invisible characters and no ASCII punctuation around it."""
    return F.regexp_replace(F.regexp_replace(token, _HIDDEN, ""), EDGES, "")


def is_lost(token):
    """Whether a token has letters that are lost for good."""
    return token.contains("�") | (token.rlike(LOST) & ~token.rlike(ADDRESS))


def odd_tokens(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows ``keys, token, core`` for each different token of a row that holds a non-ASCII character or lost letters.

    Only such tokens leave the scan; pure ASCII words, the bulk of the text, are dropped before any shuffle.
    """
    tokens = F.array_distinct(F.filter(F.split(F.col(text), SPLIT), lambda t: t.rlike(r"[^\x00-\x7f]") | is_lost(t)))
    return (
        texts.where(F.col(text).rlike(r"[^\x00-\x7f]|" + LOST))
        .select(*keys, F.explode(tokens).alias("token"))
        .withColumn("core", _core(F.col("token")))
    )


def _forms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        form, original, steps = [], [], []
        for word in batch["core"]:
            for f, n in garbled_forms(word).items():
                form.append(f), original.append(word), steps.append(n)
        yield pd.DataFrame({"form": form, "original": original, "steps": pd.Series(steps, dtype="int32")})


#: Words that one task makes forms of: about 17 forms each.
WORDS_A_TASK = 4_000


def garbled_table(clean: DataFrame) -> DataFrame:
    """``form, original, steps`` of every distinct clean word (column ``core``, checkpointed) under all chains, one row a form.

    The forms are made once, spread over tasks by the number of words, and checkpointed: they are read twice.
    """
    # partitions in turn, not by key: those the planner takes for the ones of the words before and joins to few again
    forms = cut(clean.repartition(max(1, -(-clean.count() // WORDS_A_TASK))).mapInPandas(_forms_of, "form string, original string, steps int"))
    # a garbled form may look like a word itself ("fĂŞte"): it is no original then
    twice = clean.join(forms.select("form"), clean["core"] == forms["form"], "left_semi").select(F.col("core").alias("original"))
    forms = forms.join(twice, "original", "left_anti")
    return forms.groupBy("form").agg(F.min(F.struct("steps", "original")).alias("m")).select("form", "m.original", "m.steps")


class LetterForms:
    """Garbled forms of single letters, and their use on the odd runs of a token."""

    def __init__(self, letters: list[str]):
        best: dict[str, tuple[int, str]] = {}
        for letter in sorted(letters):
            for form, steps in garbled_forms(letter).items():
                if len(form) > 1 and (form not in best or (steps, letter) < best[form]):
                    best[form] = (steps, letter)
        self.forms = {f: o for f, (_, o) in best.items()}
        self.longest = max(map(len, self.forms), default=0)

    def _spelled(self, token: str) -> tuple[str, list[tuple[str, str]]]:
        """The token with the longest known forms put right, and each ``form, letter`` used."""
        out, used, i = [], [], 0
        while i < len(token):
            for n in range(min(self.longest, len(token) - i), 1, -1):
                if (letter := self.forms.get(token[i : i + n])) is not None:
                    out.append(letter), used.append((token[i : i + n], letter))
                    i += n
                    break
            else:
                out.append(token[i])
                i += 1
        return "".join(out), used

    def restore(self, token: str) -> tuple[str, bool] | None:
        """The token with its garbled letters put right, and whether that is verified; None if it has none.

        Verified: one chain makes all its garbled letters out of the letters put in their place, so the way back is the way it came.
        """
        fixed, used = self._spelled(token)
        if not used:
            return None
        return fixed, any(all(garble(letter, chain) == form for form, letter in used) for chain in CHAINS)


def repair_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token, original, lost`` for each distinct garbled token of the texts; ``original`` is null where letters are lost.

    Distinct tokens are counted out before anything is joined, so a token or text that a third of all rows share
    costs one row here.
    """
    distinct = odd_tokens(texts, [], text).groupBy("token", "core").count()
    return repair_table_of(distinct)


def repair_table_of(distinct: DataFrame) -> DataFrame:
    """As :func:`repair_table`, from a table of distinct ``token, core``."""
    spark = distinct.sparkSession
    is_clean = F.pandas_udf(lambda s: s.map(is_clean_word), T.BooleanType())
    distinct = cut(distinct.select("token", "core").withColumn("clean", is_clean("core")))
    clean = cut(distinct.where("clean").select("core").distinct())
    words = garbled_table(clean)
    lost = distinct.where(is_lost(F.col("token"))).select("token", F.lit(None).cast("string").alias("original"), F.lit(True).alias("lost"))
    rest = distinct.where(~is_lost(F.col("token")))
    joined = cut(rest.join(words, rest["core"] == words["form"], "left").select("token", "core", "original"))
    by_word = joined.where(F.col("original").isNotNull()).select(
        "token", F.expr(f"replace(regexp_replace(token, '{_HIDDEN}', ''), core, original)").alias("original"), F.lit(False).alias("lost")
    )
    letters = clean.select(F.explode(F.array_distinct(F.split(F.regexp_replace("core", r"[\x00-\x7f]", ""), ""))).alias("c")).where("c <> ''").distinct()
    rows = letters.limit(MAX_LETTERS + 1).collect()  # bounded by the letters Unicode has, not by the corpus
    if len(rows) > MAX_LETTERS:
        raise ValueError("more distinct letters than Unicode has")
    known = spark.sparkContext.broadcast(sorted({r["c"] for r in rows} | set(CLEAN_SIGNS + COMMON_LETTERS)))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = LetterForms(known.value)
        for batch in batches:
            found = [(t, forms.restore(re.sub(_HIDDEN, "", t))) for t in batch["token"]]
            # what no one chain explains is reported, but not put in the text
            yield pd.DataFrame([(t, r[0] if r[1] else None, not r[1]) for t, r in found if r], columns=["token", "original", "lost"])

    by_letter = joined.where(F.col("original").isNull()).select("token").mapInPandas(spell, "token string, original string, lost boolean")
    return by_word.unionByName(by_letter).unionByName(lost)


def find_garbled(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, n_garbled, lost`` for each row whose text holds garbled letters."""
    tokens = odd_tokens(texts, keys, text)
    repairs = cut(repair_table(texts, text))
    hit = tokens.join(repairs.select("token", "lost"), "token")
    return hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_garbled"), F.max("lost").alias("lost"))


def restore(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, restored, fully`` for each garbled row: the text with what can be restored, white space untouched."""
    tokens = odd_tokens(texts, keys, text)
    repairs = cut(repair_table(texts, text))
    hit = tokens.join(repairs, "token").groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("original", "token")))).alias("_m"), (~F.max("lost")).alias("fully")
    )  # a row's own different odd tokens: bounded by one text
    parts = F.split(F.col(text), r"(?<=[ \t\r\n\x0b\x0c])|(?=[ \t\r\n\x0b\x0c])")
    fixed = F.array_join(F.transform(parts, lambda t: F.coalesce(F.col("_m")[t], t)), "")
    return texts.select(*keys, text).join(hit, keys).select(*keys, fixed.alias("restored"), "fully")
