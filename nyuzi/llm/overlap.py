"""Same or nearly same texts across splits: minwise hashes in bands, cross-split candidates only, exact checks.

Rows are first collapsed to distinct sentences with the sides they stand on, so copies cost nothing after that; only
sentences of different sides meet in a bucket. Candidates are verified by the exact Jaccard similarity of their shingles and words, as
multisets, against the least that the edits allowed to their length leave, and then by word and letter distance. Equal sentences are joined on
the key and need no bucket.

Letter shingles, without blanks, catch changed letters, words catch changed words however long those are. One letter in ten leaves shingles a
similarity of 0.44 or more, and 0.47 to 0.55 in most texts; 96 bands of 4 hashes let 0.44 meet with probability 0.97, 0.47 with 0.99. One word in six leaves
words 0.71 or more, which 24 bands of 4 let meet with probability 0.999. Four hashes a band keep chance meetings, which grow with the square
of the corpus, rare: unrelated sentences of one language share about 0.04.

Defined results: null, blank and shorter texts are in no pair; rows without a split are in no pair; a row is never paired with
itself; repeated rows are paired each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nyuzi.llm.minhash import banded, shingles, words
from nyuzi.llm.textnorm import sentence_key_udf
from nyuzi.session import cut

TRAIN, HELD_OUT = 1, 2
BANDS, ROWS, Q, WORD_BANDS, WORD_ROWS = 96, 4, 4, 24, 4

def side_of(split):
    """1 for train, 2 for dev (also called valid or validation) and test, null without a split."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", TRAIN).when(s.isin("dev", "valid", "validation", "test"), HELD_OUT)


def split_name(split):
    s = F.lower(F.trim(split))
    return F.when(s.isin("dev", "valid", "validation"), "dev").when(s.isin("train", "test"), s)


def edit_distance(a, b, most: int) -> int:
    """Levenshtein distance of two sequences; ``most + 1`` if it is more than ``most``.

    What both begin and end with is left out. The rest is Myers' bit-vector recurrence on whole columns: a column of the table is a few
    numbers of as many bits as ``a`` has symbols, so long texts take a handful of operations a symbol.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    first, short = 0, min(len(a), len(b))
    while first < short and a[first] == b[first]:
        first += 1
    last = 0
    while last < short - first and a[len(a) - 1 - last] == b[len(b) - 1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    places: dict[object, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    at = {x: _bits(p, len(a)) for x, p in places.items()}
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for j, x in enumerate(b):
        eq = at.get(x, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (every & ~(level | up)), up & level
        score += 1 if more & top else -1 if less & top else 0
        if score - (len(b) - 1 - j) > most:
            return most + 1
        more, less = ((more << 1) | 1) & every, (less << 1) & every
        up, down = less | (every & ~(eq | down | more)), more & (eq | down)
    return min(score, most + 1)


def _bits(places: list[int], size: int) -> int:
    """A number with the bits of these places set."""
    if size <= 64:
        return sum(1 << i for i in places)
    row = np.zeros(size, np.uint8)
    row[places] = 1
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def nearly_same(a: str, b: str) -> bool:
    """At most one word in six or one letter in ten added, dropped or replaced, of the longer sentence."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    most = max(len(x), len(y)) // 6
    if most and edit_distance(x, y, most) <= most:
        return True
    p, q = "".join(x), "".join(y)
    most = max(len(p), len(q)) // 10
    return edit_distance(p, q, most) <= most


def _shared(owner_a: np.ndarray, a: np.ndarray, owner_b: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of ``n`` pairs of multisets, told apart as :mod:`nyuzi.llm.minhash` does it, and of what each pair shares."""
    size_a, size_b = np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n)
    owner, value = np.concatenate([owner_a, owner_b]), np.concatenate([a, b])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    same = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    return size_a, size_b, np.bincount(owner[1:][same], minlength=n)


def verify(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of sentences is nearly the same, and the exact Jaccard similarity of their letter shingles.

    The distance is computed only of pairs that share enough: ``k`` letters added, dropped or replaced leave all but ``Q * k`` shingles of the longer
    sentence, ``k`` words all but ``k`` of its words, ``k`` being what its length allows. As both are counted with their repeats, no pair is lost.
    """
    n = len(a)
    letters = np.array([max(len(x.replace(" ", "")), len(y.replace(" ", ""))) for x, y in zip(a, b)])
    size_a, size_b, both = _shared(*shingles(a, Q), *shingles(b, Q), n)
    jaccard = both / np.maximum(1, size_a + size_b - both)
    by_letters = both >= np.maximum(size_a, size_b) - Q * (letters // 10)
    size_a, size_b, both = _shared(*words(a), *words(b), n)
    longer = np.maximum(size_a, size_b)
    by_words = both >= longer - longer // 6
    near = np.array([(w or c) and nearly_same(x, y) for x, y, w, c in zip(a, b, by_words, by_letters)], bool)
    return near, jaccard


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            b = batch.iloc[at : at + 512]
            near, jaccard = verify(b["key_a"].tolist(), b["key_b"].tolist())
            yield b[["kid_a", "kid_b"]].assign(jaccard=jaccard)[near]


def sentences(rows: DataFrame, key_id: str, text: str, split: str, min_words: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key_id, *carry, side, split, kid, key`` of rows that can be in a pair; ``kid`` is the 128-bit hash of the sentence."""
    s = rows.where(side_of(F.col(split)).isNotNull() & F.col(text).isNotNull()).select(
        key_id, *carry, side_of(F.col(split)).alias("side"), split_name(F.col(split)).alias("split"), sentence_key_udf(text).alias("key")
    )
    return s.where(F.size(F.split("key", " ")) >= min_words).withColumn("kid", F.unhex(F.md5("key")))


def near_links(sents: DataFrame) -> DataFrame:
    """``kid_a, kid_b, jaccard``: each train sentence with each different held-out sentence nearly the same."""
    reps = cut(sents.groupBy("kid").agg(F.min("key").alias("key"), F.bit_or("side").alias("sides")))
    reps = reps.withColumn("no", F.monotonically_increasing_id())  # rows of a checkpoint keep their order; short numbers halve the bands
    # each side goes through the bands on its own, so its rows are hashed once and go straight to the shuffle
    of = lambda side, no: banded(reps.where(F.col("sides").bitwiseAND(side) > 0).select(F.col("no").alias(no), "key"), "key", [no], BANDS, ROWS, Q, WORD_BANDS, WORD_ROWS)
    left, right = of(TRAIN, "no_a"), of(HELD_OUT, "no_b")
    pairs = left.join(right, "bucket").where("no_a <> no_b").select("no_a", "no_b").distinct()
    one = lambda x: reps.select(F.col("no").alias(f"no_{x}"), F.col("kid").alias(f"kid_{x}"), F.col("key").alias(f"key_{x}"))
    named = pairs.join(one("a"), "no_a").join(one("b"), "no_b").select("kid_a", "kid_b", "key_a", "key_b")
    return named.mapInPandas(_verify, "kid_a binary, kid_b binary, jaccard double")


def cross_split_pairs(rows: DataFrame, key_id: str, text: str, split: str, min_words: int = 5) -> DataFrame:
    """``id_a, id_b`` (smaller first) of every train row and held-out row with the same or nearly the same sentence."""
    sents = cut(sentences(rows, key_id, text, split, min_words))
    links = near_links(sents).select("kid_a", "kid_b")
    same = sents.groupBy("kid").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == (TRAIN | HELD_OUT)).select(F.col("kid").alias("kid_a"), F.col("kid").alias("kid_b"))
    train = sents.where(F.col("side") == TRAIN).select(F.col("kid").alias("kid_a"), F.col(key_id).alias("t"))
    held = sents.where(F.col("side") == HELD_OUT).select(F.col("kid").alias("kid_b"), F.col(key_id).alias("h"))
    pairs = links.unionByName(same).join(train, "kid_a").join(held, "kid_b").where("t <> h")
    return pairs.select(F.least("t", "h").alias("id_a"), F.greatest("t", "h").alias("id_b")).distinct()


def overlap_report(rows: DataFrame, key_id: str, text: str, split: str, source: str, min_words: int = 5) -> DataFrame:
    """``split, source, n_rows, n_same, n_near``: held-out rows by split and source, and how many stand in train exactly or nearly.

    Counted through sentence classes: no copy is expanded into pairs.
    """
    sents = cut(sentences(rows, key_id, text, split, min_words, (source,)))
    near = near_links(sents).select(F.col("kid_b").alias("kid")).distinct().withColumn("near", F.lit(1))
    same = sents.groupBy("kid").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == (TRAIN | HELD_OUT)).select("kid", F.lit(1).alias("same"))
    held = sents.where(F.col("side") == HELD_OUT).groupBy("kid", "split", source).agg(F.count(F.lit(1)).alias("n"))
    met = held.join(same, "kid", "left").join(near, "kid", "left")
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return met.groupBy("split", source).agg(
        F.sum("n").alias("n_rows"), amount(F.col("same").isNotNull()).alias("n_same"), amount(F.col("same").isNull() & F.col("near").isNotNull()).alias("n_near")
    )
