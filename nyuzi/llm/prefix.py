"""Running sums over large groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, each: int = 100_000) -> int:
    """A power of two of ranges that hold about ``each`` rows."""
    return 1 << max(4, (max(1, rows) // each).bit_length())


def running_sum(df: DataFrame, group: list[str], order: Column, amount: str, out: str, buckets: int = 4096) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows before each row of its group, in the order of a hash of ``order``.

    Rows fall into ``buckets`` ranges of the hash; the sums of the ranges are at most ``buckets`` rows a group and
    are added up first, then each range is summed within. So a group that holds a third of all rows is spread over all
    ranges. Equal hashes keep the order of ``order`` itself.
    """
    hashed = df.withColumn("_h", F.xxhash64(order)).withColumn("_b", F.shiftrightunsigned("_h", 64 - (buckets - 1).bit_length()).cast("int")).withColumn("_o", order)
    sums = hashed.groupBy(*group, "_b").agg(F.sum(amount).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    # shiftrightunsigned orders ranges by the unsigned hash; inside a range the sign is the same for all rows
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(*group, "_b").orderBy("_h", "_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    joined = hashed.withColumn("_w", within).alias("l").join(before.alias("r"), [*keys, F.col("l._b") == F.col("r._b")], "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._w") + F.coalesce(F.col("r._before"), F.lit(0))).alias(out))
