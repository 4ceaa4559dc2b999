"""Corpus error rates from per-row edit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nyuzi.functions import text as X


def edit_counts(ref: Column, hyp: Column, prefix: str) -> list[Column]:
    """Word and letter edits of a pair and the sizes of its reference. An empty reference counts all of the hypothesis as insertions."""
    r, h = X.words(ref), X.words(hyp)
    return [
        X.token_edits(r, h).alias(f"{prefix}_word_edits"),
        F.size(r).cast("bigint").alias(f"{prefix}_words"),
        X.letter_edits(ref, hyp).alias(f"{prefix}_letter_edits"),
        F.char_length(ref).cast("bigint").alias(f"{prefix}_letters"),
    ]


def rate(edits: str, size: str) -> Column:
    """Sum of edits over sum of sizes; null where nothing is there to be recognized."""
    return F.round(F.sum(edits) / F.nullif(F.sum(size), F.lit(0)), 9)


def error_rates(pairs: DataFrame, group: str, ref: str, hyp: str) -> DataFrame:
    """``raw_wer, raw_cer, norm_wer, norm_cer`` and rows of each group: corpus rates, not means of row rates."""
    raw = edit_counts(F.col(ref), F.col(hyp), "raw")
    norm = edit_counts(X.normalize(F.col(ref)), X.normalize(F.col(hyp)), "norm")
    each = pairs.select(group, *raw, *norm)
    return each.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        rate("raw_word_edits", "raw_words").alias("raw_wer"),
        rate("raw_letter_edits", "raw_letters").alias("raw_cer"),
        rate("norm_word_edits", "norm_words").alias("norm_wer"),
        rate("norm_letter_edits", "norm_letters").alias("norm_cer"),
    )


def macro_mean(rates: DataFrame) -> DataFrame:
    """Unweighted mean over the groups, however large each is."""
    return rates.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("raw_wer"), 9).alias("mean_raw_wer"), F.round(F.avg("norm_wer"), 9).alias("mean_norm_wer"))


def tag_impact(pairs: DataFrame, group: str, ref: str, hyp: str) -> DataFrame:
    """Word error rate with tags in the references, without them, and the difference, from one pass."""
    plain = edit_counts(F.col(ref), F.col(hyp), "raw")[:2]
    bare = edit_counts(X.strip_tags(F.col(ref)), F.col(hyp), "bare")[:2]
    out = pairs.select(group, *plain, *bare).groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), rate("raw_word_edits", "raw_words").alias("wer_raw"), rate("bare_word_edits", "bare_words").alias("wer_notags"))
    return out.withColumn("delta", F.round(F.col("wer_raw") - F.col("wer_notags"), 9))


def word_diff(pairs: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """``keys, diff_no, ref_at, hyp_at, ref_words, hyp_words``: every stretch that the lower-cased texts do not share, numbered within its row.

    ``ref_at`` and ``hyp_at`` count the words before it; an empty array on one side is an insertion or a deletion. Which words are shared
    is settled by the longest common runs first. Rows whose texts do not differ, or lack one of them, have no stretch.
    """
    import difflib
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    source = pairs.select(*keys, F.lower(ref).alias("_ref"), F.lower(hyp).alias("_hyp")).where("_ref <> _hyp")
    words = T.ArrayType(T.StringType())
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("diff_no", "ref_at", "hyp_at")] + [T.StructField(c, words) for c in ("ref_words", "hyp_words")])

    def stretches(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """What lies between the blocks both share."""
        i = j = 0
        for block in difflib.SequenceMatcher(None, a, b).get_matching_blocks():
            if block.a > i or block.b > j:
                yield i, block.a, j, block.b
            i, j = block.a + block.size, block.b + block.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, columns = [], [[], [], [], [], []]
            for at, (x, y) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                a, b = x.split(), y.split()
                for no, (i, k, j, m) in enumerate(stretches(a, b)):
                    row.append(at)
                    for column, value in zip(columns, (no, i, j, a[i:k], b[j:m])):
                        column.append(value)
            kinds = [pa.int32()] * 3 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns[: len(keys)]), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return source.mapInArrow(run, schema)
