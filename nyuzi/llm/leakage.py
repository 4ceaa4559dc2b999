"""Evaluation texts inside a training corpus: q-gram lemma filtering in diagonal bands, verified by banded alignment.

The q-grams of the items are a lookup table on the executors (its size is checked in letters; more items are taken in blocks of
items, each a pass of its own, so no item count is too large). The corpus is read once a block and never shuffled. In a
document, each letter q-gram that an item shares lies on a diagonal, the word of the document it begins in less the word of the item; since a
word that is changed, added or left out moves the diagonal by one word at most, however long it is, a run lies within as many diagonals as
the item's edit budget. Counts are kept in overlapping bands of twice that width, and a region is kept when its count reaches the least
that the q-gram lemma leaves of any run that counts, over all lengths from half the item to the whole, each with its own budget. Only
there are the words aligned. Items so short that the lemma leaves nothing are aligned with every document that shares a word. So the filter
drops no run that the alignment would accept.

Defined results: null and empty texts hold nothing; items without words are never found; an item found twice in a document is
one row; repeated documents are each reported; a document without an id is
reported with a null id, an item without one is ignored; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nyuzi.llm.textnorm import sentence_words

#: Letters of a q-gram.
Q = 8
#: Letters of the items looked up at once: an index takes about 16 bytes a letter, 128 MB in a Python worker.
BLOCK_LETTERS = 8 << 20
#: Letters of a document, and its shared q-grams, that are looked at together; counts are added up over such slices.
SLICE, MOST_HITS = 1 << 20, 1 << 20
_LINE_MARK = re.compile(r"(?m)^[ \t]*(?:[A-Z]:|\d{1,3}[.)]|[-*•])[ \t]+")


def document_words(text: str | None) -> list[str]:
    """Words of a document without the marks that begin dialogue and list lines."""
    return sentence_words(_LINE_MARK.sub("", text)) if text else []


class Rule(NamedTuple):
    """Least share of an item's words in a run, and most share of the run's words changed."""

    part: float = 0.5
    changed: float = 0.1


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams of an array of code points, in place."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    n = len(code) - q + 1
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x100000001B3) + code[j : j + n]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def codes(key: str) -> np.ndarray:
    return np.frombuffer(key.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Items:
    """The q-gram index of a block of items, each a list of words."""

    BITS = 22

    def __init__(self, items: list[list[str]], rule: Rule = Rule()):
        self.rule, self.words = rule, items
        hashes, owner, place = [], [], []
        for k, words in enumerate(items):
            h = grams(codes(" ".join(words)))
            hashes.append(h), owner.append(np.full(len(h), k, np.int32)), place.append(word_places(words)[: len(h)])
        self.need = np.array([least_shared(words, rule) for words in items], np.int64)
        #: A run's diagonals differ by at most its budget, so it lies in one band of twice this width, one beginning each such width.
        self.half = np.array([int(len(words) * rule.changed) + 1 for words in items], np.int64)
        #: Items of which a run may share no q-gram.
        self.bare = [k for k, words in enumerate(items) if words and self.need[k] < 1]
        self.sets = {k: set(items[k]) for k in self.bare}
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], (np.concatenate(owner)[order] if hashes else np.zeros(0, np.int32)), (np.concatenate(place)[order] if hashes else np.zeros(0, np.int32))
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.hash >> np.uint64(64 - self.BITS)] = True

    def _hits(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the index and words of the document of shared q-grams, a bounded number at a time."""
        code, at_word = codes(" ".join(words)), word_places(words)
        for begin in range(0, max(1, len(code) - Q + 1), SLICE):
            h = grams(code[begin : begin + SLICE + Q - 1])
            at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.BITS)])
            if not len(at):
                continue
            low = np.searchsorted(self.hash, h[at], "left")
            count = np.searchsorted(self.hash, h[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            if not len(at):
                continue
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) // MOST_HITS)) + 1):
                n = count[part]
                hit = np.repeat(low[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                yield hit, np.repeat(at_word[begin + at[part]], n).astype(np.int64)

    def regions(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``item, first and last word of the document`` of the bands that hold enough shared q-grams."""
        parts = []
        for hit, word in self._hits(words):
            item = self.owner[hit].astype(np.int64)
            band = (word - self.place[hit]) // self.half[item]
            key, word = np.concatenate([item, item]) * (1 << 33) + np.concatenate([band, band - 1]) + (1 << 31), np.concatenate([word, word])
            parts.append(_summed(key, np.ones(len(key), np.int64), word, word))
        if not parts:
            return []
        key, size, low, high = parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts)))
        item = key >> 33
        keep = size >= self.need[item]
        return [(int(i), int(a), int(b)) for i, a, b in zip(item[keep], low[keep], high[keep])]


def word_places(words: list[str]) -> np.ndarray:
    """For each letter of the words joined by blanks, the word it belongs to; a blank belongs to the word before."""
    return np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 1 for w in words])


def least_shared(words: list[str], rule: Rule, q: int = Q) -> int:
    """q-gram lemma: q-grams that the text keeps of any run of at least ``rule.part`` of the words, whatever words its own budget changes.

    A changed word takes at most its letters and q - 1 more q-grams with it, one left out also those of its blank, one added q - 1.
    """
    n = len(words)
    if not n:
        return 1 << 40
    size = np.array([len(w) for w in words])
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    cost = np.concatenate(([0], np.cumsum(np.sort(size)[::-1] + q)))
    least = max(1, int(np.ceil(n * rule.part)))
    return min(int((ends[run:] - ends[: n + 1 - run]).min()) - 1 - q + 1 - int(cost[int(run * rule.changed)]) for run in range(least, n + 1))


def _summed(key: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys with the sum, least and greatest of what they hold."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(size[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def longest_run(item: list[str], text: list[str], rule: Rule = Rule()) -> int:
    """Words of the longest run of the item found in the text with at most ``changed`` of its words changed.

    ``longest[e]`` holds, for each place in the text, the length of the longest run of the item that ends here with exactly ``e``
    words changed, added or left out; all places and all ``e`` go on together for each word of the item.
    """
    n, m = len(item), len(text)
    most = int(n * rule.changed)
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    t = np.array([number.get(w, -1) for w in text])
    none = -(10**6)
    prev = np.full((most + 1, m + 1), none)
    prev[0] = 0
    best = 0
    for w in item:
        new = np.full((most + 1, m + 1), none)
        match = t == number[w]
        new[:, 1:] = np.where(match, prev[:, :-1] + 1, none)
        if most:
            # a changed word, a word of the item left out, a word added in the text
            new[1:, 1:] = np.maximum(new[1:, 1:], prev[:-1, :-1] + 1)
            new[1:] = np.maximum(new[1:], prev[:-1] + 1)
            for e in range(1, most + 1):
                new[e, 1:] = np.maximum(new[e, 1:], new[e - 1, :-1])
        new[0] = np.maximum(new[0], 0)
        for e in range(most + 1):
            top = int(new[e].max())
            if e <= top * rule.changed and top > best:
                best = top
        prev = new
    return best


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _leaks_of(text: str | None, items: Items) -> list[int]:
    """The items that a document holds a run of."""
    words = document_words(text)
    if not words:
        return []
    spans: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in items.regions(words):
        # a run reaches at most its own length beyond the q-grams it shares
        reach = len(items.words[k]) + int(items.half[k])
        spans.setdefault(k, []).append((max(0, a - reach), min(len(words), b + reach + 1)))
    if items.bare:
        here = set(words)
        spans |= {k: [(0, len(words))] for k in items.bare if not here.isdisjoint(items.sets[k])}
    found = []
    for k, of in sorted(spans.items()):
        item = items.words[k]
        if any(longest_run(item, words[a:b], items.rule) >= len(item) * items.rule.part for a, b in _joined(of)):
            found.append(k)
    return found


_built: dict[str, Items] = {}


def _index_of(name: str, words: list[list[str]], rule: Rule) -> Items:
    """The index of a block, built once a Python worker, not once a task."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(words, rule)
    return _built[name]


def find_leaks(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), block: int = BLOCK_LETTERS) -> DataFrame:
    """``item_id, doc_id`` for each document that holds a run of an item. Items go in blocks of about ``block`` letters."""
    spark = docs.sparkSession
    held = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n = held.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    blocks = max(1, -(-n // block))
    held = held.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = held.where(F.col("_b") == b).select("item_id", "text").orderBy("item_id").collect()  # one block of checked size
        index = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [sentence_words(r["text"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], index=index, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block_items = _index_of(name, index.value[1], rule)
            ids = pa.array(index.value[0], id_type)
            for b in batches:
                hits = [(k, i) for i, t in enumerate(b.column(1).to_pylist()) for k in _leaks_of(t, block_items)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([k for k, _ in hits], pa.int64())), b.column(0).take(pa.array([i for _, i in hits], pa.int64()))], names=["item_id", "doc_id"]
                )

        schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType)])
        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, held_out, lang, n_docs``: every item with the number of documents that hold it."""
    hits = find_leaks(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "held_out", "lang").join(hits, "item_id", "left").select("item_id", "held_out", "lang", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_docs"))
