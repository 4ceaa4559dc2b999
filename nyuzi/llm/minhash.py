"""Minwise hash signatures of letter shingles and words, in bands, many keys at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Shingles and words whose hashes are computed together: 4 bytes each in a few arrays.
TOGETHER = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    """A well spread 32-bit form of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32)


def _numbered(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second and later copies of a value of one owner told apart, so that a set of them is the multiset; sorted by owner and value."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    n = np.arange(len(value))
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    copy = n - np.maximum.accumulate(np.where(new, n, 0))
    return owner, value * np.uint64(0xBF58476D1CE4E5B9) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def shingles(keys: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """``owner, value``: the multiset of ``q``-letter shingles of each key without its blanks, ``q - 1`` marks before and after it.

    A key of n letters has n + q - 1 of them, of which one letter added, dropped or replaced changes at most ``q``.
    """
    pad = "\x00" * (q - 1)
    texts = [k.replace(" ", "") for k in keys]
    code = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + q - 1 for t in texts])
    h = np.zeros(size.sum(), np.uint64)
    for j in range(q):
        h = (h ^ code[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return _numbered(np.repeat(np.arange(len(keys)), size), h)


def words(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``owner, value``: the multiset of words of each key."""
    split = [k.split(" ") for k in keys]
    value = np.array([(zlib.crc32(w.encode("utf-8", "surrogatepass")) << 32) | zlib.adler32(w.encode("utf-8", "surrogatepass")) for s in split for w in s], np.uint64)
    return _numbered(np.repeat(np.arange(len(keys)), [len(s) for s in split]), value)


class Bands:
    """Bands of minwise hashes of letter shingles and of words; the same seed gives the same bands everywhere.

    ``bands`` bands of ``rows`` hashes each of the ``q``-letter shingles, then ``word_bands`` bands of ``word_rows`` of the words.
    """

    def __init__(self, bands: int, rows: int, q: int, word_bands: int = 0, word_rows: int = 4, seed: int = 7):
        self.families = []
        rng = np.random.default_rng(seed)
        odd = lambda n, top, kind: (rng.integers(1, top, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(kind)
        first = 0
        for n, r, make in ((bands, rows, lambda k: shingles(k, q)), (word_bands, word_rows, words)):
            number = np.arange(first, first + n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            self.families.append((make, n, r, odd(n * r, 2**31, np.uint32), rng.integers(0, 2**32, n * r, dtype=np.uint64).astype(np.uint32), odd(r, 2**63, np.uint64), number))
            first += n
        self.bands = first

    def buckets(self, keys: list[str]) -> np.ndarray:
        """An array of one row a key and one column a band. No key is empty."""
        out = []
        for make, n, r, mul, add, mix, number in self.families:
            if not n:
                continue
            owner, value = make(keys)
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            h = _mixed(value)
            low = np.empty((n * r, len(keys)), np.uint32)
            x = np.empty_like(h)
            for j in range(n * r):
                np.multiply(h, mul[j], out=x)
                np.add(x, add[j], out=x)
                np.minimum.reduceat(x, start, out=low[j])
            out.append((low.T.reshape(len(keys), n, r) * mix).sum(axis=2, dtype=np.uint64) ^ number)
        return np.concatenate(out, axis=1).view(np.int64)


def banded(df: DataFrame, key: str, carry: list[str], *shape: int) -> DataFrame:
    """One row ``*carry, bucket`` for each band of each key; ``shape`` as :class:`Bands` takes it."""
    source = df.select(*carry, key)
    schema = T.StructType([source.schema[c] for c in carry] + [T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Bands(*shape)
        for batch in batches:
            # keys go together by their letters, so long ones do not add up
            part = (np.cumsum(batch[key].str.len().to_numpy()) // TOGETHER) if len(batch) else np.zeros(0)
            for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
                if len(at):
                    out = batch[carry].iloc[np.repeat(at, maker.bands)].reset_index(drop=True)
                    out["bucket"] = maker.buckets(batch[key].iloc[at].tolist()).reshape(-1)
                    yield out

    return source.mapInPandas(run, schema)
