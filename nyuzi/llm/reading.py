"""How demanding a document's text is, on the scale people graded, by harmonic propagation over a similarity graph.

Two measures place a document within its language: the log of its mean sentence length, and how long and rare its words are: the log of their
mean length and the mean log of how rarely the corpus uses them, in equal parts; all as distances from the language's mean in its standard
deviations. Words are counted over all documents; rarity is told apart among the ``COMMON_WORDS`` commonest words of a language, what
stands in no such list is as rare as the last of it. Layouts decide what a sentence is: prose and list, dialogue and line marks end or begin one,
running text without punctuation has none and is placed by its words alone. Documents are joined to the cells they fall in of six overlapping
grids, three widths in two positions: documents that share cells are similar. Graded documents are clamped to their grades, and difficulty runs
along the graph in harmonic steps until no level moves by ``TOLERANCE``: a cell takes the weighted mean of its documents, an ungraded document that
of its cells.

All cell borders are multiples of one step, so documents between the same borders are one node with a count; the graph has at
most ``(2 * REACH / STEP) ** 2`` nodes whatever the size of the corpus, and only the one pass that measures texts grows with it.

Defined results: a document without words has no level (null) and is never demanding; a null language is inferred from the letters;
grades that are null are ignored; several grades of one document are averaged and are its level; without any grade all levels are null; ungraded
copies get one level; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.session import cut

#: Widths of the grids in standard deviations, positions, the common step of all borders, and the farthest distance told apart.
WIDTHS, SHIFTS, STEP, REACH = (0.15, 0.3, 0.6), (0.0, 0.5), 0.075, 6.0
#: Weight of an ungraded document in a cell against a graded one, and of the empty prior in a cell.
UNGRADED, PRIOR = 0.1, 0.5
#: Most rounds, and the largest move of a level at which they end.
ROUNDS, TOLERANCE = 60, 0.02
#: Partitions of the graph, which the grid bounds to about 150,000 edges.
PARTS = 4
#: Most documents of known language that the language guess is fitted on.
LANGUAGE_SAMPLE = 4_000
#: Languages up to which their means are broadcast; the registry of languages has fewer.
MAX_LANGUAGES = 10_000
#: Words of a language whose frequency is told apart, and of all languages together: about 50 bytes each on an executor core.
COMMON_WORDS, ALL_WORDS = 5_000, 500_000

_TAG = re.compile(r"\[[^\[\]]*\]")
_MARK = re.compile(r"(?m)^[ \t]*(?:[A-Z]:|\d{1,3}[.)]|[-*•])[ \t]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?][\"”»')\]]*(?:\s+|$)")


def words_of(text: str | None) -> tuple[str, list[str]]:
    """A text without tags and marks, and its words."""
    t = _MARK.sub("", _TAG.sub(" ", text)).strip() if text else ""
    return t, _WORD.findall(t)


class Commonness:
    """The log of how often each common word of a language stands among its words."""

    def __init__(self, rows: list[tuple[str | None, str, int, int]]):
        self.logs: dict[str | None, dict[str, float]] = {}
        for lang, word, n, total in rows:
            self.logs.setdefault(lang, {})[word] = math.log(n / total)
        self.least = {lang: min(words.values()) for lang, words in self.logs.items()}

    def rarity(self, lang: str | None, words: list[str]) -> float:
        if lang not in self.logs:
            return 0.0
        logs, least = self.logs[lang], self.least[lang]
        return -sum(n * logs.get(w, least) for w, n in Counter(map(str.lower, words)).items()) / len(words)


def measure(text: str | None, lang: str | None = None, common: Commonness | None = None) -> tuple[int, float, float, float | None]:
    """Words of a text, the log of their mean length, their rarity, and the log of the mean sentence length (None where nothing tells sentences)."""
    t, words = words_of(text)
    if not words:
        return 0, 0.0, 0.0, None
    n = len(words)
    ends = len(_END.findall(t))
    lines = [x for x in t.split("\n") if x.strip()]
    if ends * 60 > n or ends > 1:
        pieces = (p for line in lines for p in _END.split(line))
        count = sum(1 for p in pieces if p and _WORD.search(p))
    elif len(lines) > 1 and "\n\n" not in t:
        count = len(lines)  # a sentence a line, without punctuation
    else:
        count = 0
    length = math.log(sum(map(len, words)) / n)
    return n, length, common.rarity(lang, words) if common else 0.0, math.log(n / count + 1) if count else None


_GUESS, _PIECE = 1 << 14, 1 << 16


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed letter trigram stands in the whole text, a piece of it at a time."""
    out = np.zeros(_GUESS, np.int64)
    t = f" {text.lower()} "
    for at in range(0, len(t) - 2, _PIECE):
        code = np.frombuffer(t[at : at + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = (code[:-2] * np.uint64(31) + code[1:-1]) * np.uint64(31) + code[2:]
        out += np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=_GUESS)
    return out


class LanguageGuess:
    """Naive Bayes over hashed letter trigrams; ``counts`` are rows of language, trigram and how often it stands there."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        table = np.full((len(self.langs), _GUESS), 0.5)
        for lang, gram, n in counts:
            table[at[lang], gram] += n
        self.score = np.log(table / table.sum(axis=1, keepdims=True)) if self.langs else table

    def __call__(self, text: str) -> str | None:
        return self.langs[int(np.argmax(self.score @ trigram_counts(text)))] if self.langs and text else None


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[lang] = sums.get(lang, 0) + trigram_counts(text)
        at = {lang: np.flatnonzero(s) for lang, s in sums.items()}
        columns = [pa.array([lang for lang, g in at.items() for _ in g], pa.string())] + [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (at.values(), [sums[lang][g] for lang, g in at.items()])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])


def language_guess(docs: DataFrame) -> LanguageGuess:
    """Fitted on about ``LANGUAGE_SAMPLE`` documents by their hash, never more than twice as many; what comes to the driver is their trigram counts."""
    part = int(2**31 * min(1.0, LANGUAGE_SAMPLE / max(1, docs.count())))
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < part).select("lang", "text").limit(2 * LANGUAGE_SAMPLE)
    sums = known.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return LanguageGuess([tuple(r) for r in sums.collect()])


def common_words(counts: DataFrame) -> Commonness:
    """From ``lang, word, n``: the commonest words of each language, at most ``ALL_WORDS`` together, with the words of all its documents."""
    totals = cut(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    most = max(1, min(COMMON_WORDS, ALL_WORDS // max(1, totals.count())))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # each task keeps its first ones before the shuffle
    top = counts.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= most).drop("_k")
    met = top.alias("a").join(totals.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.lang", "word", "n", "total")
    return Commonness([tuple(r) for r in met.limit(ALL_WORDS).collect()])


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, words, length, rarity, sentence``: two passes over whole texts, one that counts words and one that measures."""
    spark = docs.sparkSession
    guess = spark.sparkContext.broadcast(language_guess(docs))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str | None, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lang = guess.value(text) if lang is None and text else lang
                sums.setdefault(lang, Counter()).update(map(str.lower, words_of(text)[1]))
            langs = [lang for lang, c in sums.items() for _ in range(len(c))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([w for c in sums.values() for w in c], pa.string()), pa.array([n for c in sums.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"]
            )

    counts = docs.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = spark.sparkContext.broadcast(common_words(cut(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            lang = [guess.value(t) if x is None and t else x for x, t in zip(b.column(1).to_pylist(), texts)]
            got = [measure(t, x, common.value) for t, x in zip(texts, lang)]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=["doc_id", "lang", "words", "length", "rarity", "sentence"])

    source = docs.select("doc_id", "lang", "text")
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("lang string, words int, length double, rarity double, sentence double").fields])
    return source.mapInArrow(run, schema)


def placed(rows: DataFrame) -> DataFrame:
    """``doc_id, x, y`` in steps: sentence length (null where unknown) and length and rarity of words (null without words), within the language."""
    moments = [f(c).alias(f"{n}_{c}") for c in ("length", "rarity", "sentence") for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = cut(rows.where("words > 0").groupBy("lang").agg(*moments, F.covar_pop("length", "rarity").alias("both")))

    def z(c: str):
        return F.when(F.col(f"s_{c}") > 1e-9, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0))

    def step(value):
        return F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), value)) / STEP).cast("int")

    if stats.count() <= MAX_LANGUAGES:
        stats = F.broadcast(stats)  # else the planner joins by language and splits large ones
    named = rows.alias("a").join(stats.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")), "left")
    there, product = F.col("words") > 0, F.col("s_length") * F.col("s_rarity")
    # the sum of two standardized measures of correlation r has variance 2 + 2r; a measure that does not vary leaves the other alone
    spread = F.when(product > 1e-9, F.sqrt(F.greatest(F.lit(0.1), 2 + 2 * F.col("both") / product))).otherwise(F.lit(1.0))
    return named.select("doc_id", F.when(there & F.col("sentence").isNotNull(), step(z("sentence"))).alias("x"), F.when(there, step((z("length") + z("rarity")) / spread)).alias("y"))


def _cells():
    """The six cells of a node as an array of ``grid, cx, cy, w``; nodes without sentence lengths have cells of their own."""
    out = []
    weights = [1 / w for w in WIDTHS for _ in SHIFTS]
    for g, (w, s) in enumerate((w, s) for w in WIDTHS for s in SHIFTS):
        n = round(w / STEP)
        shift = round(s * n)
        cell = lambda c: F.floor((F.col(c) + shift) / n).cast("int")
        out.append(F.struct(F.lit(g).alias("grid"), F.coalesce(cell("x"), F.lit(-9999)).alias("cx"), cell("y").alias("cy"), F.lit(weights[g] / sum(weights)).alias("w")))
    return F.array(*out)


def propagate(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``grid, cx, cy, num, den``: the cells after the harmonic rounds. ``nodes``: ``x, y, free, graded, grades``."""
    nodes = cut(nodes.select("x", "y", "free", "graded", "grades", F.explode(_cells()).alias("c")).select("x", "y", "free", "graded", "grades", "c.*").coalesce(PARTS))
    mean = nodes.agg(F.try_divide(F.sum("grades"), F.sum("graded"))).first()[0]
    start = F.lit(mean).cast("double")
    both = nodes.withColumn("h", start)
    num, den = F.col("num") - UNGRADED * F.col("h"), F.col("den") - UNGRADED  # without the document itself
    trust = F.when(den > 1e-9, F.col("w") * den / (den + PRIOR))
    moved = math.inf
    for left in range(rounds, 0, -1):
        cells = both.groupBy("grid", "cx", "cy").agg(
            F.sum(F.col("grades") + UNGRADED * F.col("free") * F.col("h")).alias("num"), F.sum(F.col("graded") + UNGRADED * F.col("free")).alias("den")
        )
        if left == 1 or moved < TOLERANCE:
            return cut(cells)
        # nodes, cells and levels are bounded by the grid, so these broadcasts are too
        seen = both.join(F.broadcast(cells), ["grid", "cx", "cy"])
        level = seen.groupBy("x", "y").agg(F.coalesce(F.sum(trust * num / den) / F.sum(trust), start).alias("next"), F.first("h").alias("was"))
        level = cut(level.coalesce(PARTS)).select(F.col("x").alias("lx"), F.col("y").alias("ly"), "next", "was")
        moved = level.agg(F.max(F.abs(F.col("next") - F.col("was")))).first()[0] or 0.0
        both = nodes.join(F.broadcast(level.drop("was")), F.col("x").eqNullSafe(F.col("lx")) & (F.col("y") == F.col("ly"))).select(*nodes.columns, F.col("next").alias("h"))
    raise ValueError("at least one round is needed")


def reading_levels(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, level``: the estimate on the scale of the grades, null where a document has no words or nobody graded."""
    at = cut(placed(measures(docs)))
    grade = labels.where("level IS NOT NULL").groupBy("doc_id").agg(F.avg("level").alias("grade"))
    graded = cut(at.join(grade, "doc_id", "left"))
    held = graded.where("y IS NOT NULL")
    nodes = held.groupBy("x", "y").agg(
        F.sum(F.when(F.col("grade").isNull(), 1).otherwise(0)).alias("free"), F.count("grade").alias("graded"), F.coalesce(F.sum("grade"), F.lit(0.0)).alias("grades")
    )
    cells = propagate(nodes, rounds)
    # an ungraded node's level is the same for all its documents
    seen = held.where("grade IS NULL").select("x", "y").distinct().select("x", "y", F.explode(_cells()).alias("c")).select("x", "y", "c.*").join(F.broadcast(cells), ["grid", "cx", "cy"])
    trust = F.when(F.col("den") > 1e-9, F.col("w") * F.col("den") / (F.col("den") + PRIOR))
    level = seen.groupBy("x", "y").agg((F.sum(trust * F.col("num") / F.col("den")) / F.sum(trust)).alias("h"))
    out = graded.alias("a").join(F.broadcast(level).alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("x", "y")], "left")
    # graded documents are clamped: their level is their grade
    return out.select("doc_id", F.when(F.col("a.y").isNotNull(), F.coalesce("grade", "h")).alias("level"))


def demanding(docs: DataFrame, labels: DataFrame, least: float = 4.0) -> DataFrame:
    """``doc_id`` of documents whose level rounds to ``least`` or more."""
    return reading_levels(docs, labels).where(F.col("level") >= least - 0.5).select("doc_id")
