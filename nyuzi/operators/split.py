"""Group-disjoint dev split of a corpus, and the routing of rows by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_SPEAKER = "__unknown__"
# Share of the rows, least speakers and seed of the dev split.
DEV_SHARE, LEAST_SPEAKERS, SEED = 0.10, 12, "42"


def speaker_or_unknown(col: Column) -> Column:
    """Null and empty speakers are one speaker, moved to a side as a block."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(UNKNOWN_SPEAKER))


def histogram(df: DataFrame, language: Column, speaker: Column) -> DataFrame:
    """``language, speaker, n``: partial sums before the shuffle."""
    return df.groupBy(language.alias("language"), speaker_or_unknown(speaker).alias("speaker")).agg(F.count(F.lit(1)).alias("n"))


def dev_speakers(hist: DataFrame, share: float = DEV_SHARE, least: int = LEAST_SPEAKERS, seed: str = SEED) -> DataFrame:
    """``language, speaker, n, is_dev``: in the order of a seeded digest, speakers are dev while the rows before them are under
    ``share`` of the language's or they are among the first ``least``. Works on the histogram, never on rows.

    A language with at most ``least`` speakers is all dev. Ties of the digest go to the speaker's name. Sums and ranks are two-level,
    by the digest's first three digits and within, so a language with very many speakers is spread over 4,096 tasks.
    """
    keyed = hist.withColumn("_d", F.md5(F.concat("speaker", F.lit(seed)))).withColumn("_r", F.substring("_d", 1, 3))
    ranges = keyed.groupBy("language", "_r").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy("language").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("language").alias("_l"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_bk"),
        F.sum("_n").over(Window.partitionBy("language")).alias("_total"),
    )
    order = Window.partitionBy("language", "_r").orderBy("_d", "speaker")
    within = keyed.withColumn("_wn", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_wk", F.row_number().over(order))
    placed = within.join(ranges, F.col("language").eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_q")))
    is_dev = (F.col("_bn") + F.col("_wn") < F.lit(share) * F.col("_total")) | (F.col("_bk") + F.col("_wk") <= least)
    return placed.select("language", "speaker", "n", is_dev.alias("is_dev"))


def split_summary(assigned: DataFrame) -> DataFrame:
    """Rows, speakers, dev speakers, dev rows and dev share of each language."""
    return assigned.groupBy("language").agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("speakers"),
        F.count_if("is_dev").alias("dev_speakers"),
        F.coalesce(F.sum(F.when(F.col("is_dev"), F.col("n"))), F.lit(0)).alias("dev_rows"),
        F.round(F.coalesce(F.sum(F.when(F.col("is_dev"), F.col("n"))), F.lit(0)) / F.sum("n"), 9).alias("dev_share"),
    )


def route(df: DataFrame, assigned: DataFrame, language: Column, speaker: Column) -> DataFrame:
    """Rows with ``routed``: dev or train. The side of the dev speakers is joined as the planner sees fit; it may be large."""
    dev = assigned.where("is_dev").select(F.col("language").alias("_l"), F.col("speaker").alias("_s"))
    keyed = df.withColumn("_lang", language).withColumn("_spk", speaker_or_unknown(speaker))
    joined = keyed.join(dev, (F.col("_lang") == F.col("_l")) & (F.col("_spk") == F.col("_s")), "left")
    return joined.withColumn("routed", F.when(F.col("_s").isNotNull(), "dev").otherwise("train")).drop("_lang", "_spk", "_l", "_s")


def valid_label(text: Column) -> Column:
    """A label that is there and not empty; blanks are kept."""
    return text.isNotNull() & (F.length(text) > 0)
