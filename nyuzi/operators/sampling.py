"""Deterministic samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nyuzi.session import cut


def numbered(df: DataFrame, group: str, order: str, out: str, width: int = 1 << 20) -> DataFrame:
    """``out``: the number of rows before each row of its group in the order of an integer column.

    Two levels: ranges of ``width`` ids are counted first, then rows are numbered within a range, so a group that holds a third of
    all rows is still spread over many tasks.
    """
    ranged = df.withColumn("_r", F.floor(F.col(order) / width))
    counts = ranged.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy(group, "_r").orderBy(order)) - 1
    joined = ranged.withColumn("_w", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_q")), "left")
    return joined.withColumn(out, F.col("_w") + F.col("_b")).drop("_r", "_w", "_g", "_q", "_b")


def stride_sample(df: DataFrame, group: str, order: str, valid: Column, most: int) -> DataFrame:
    """At most ``most`` valid rows of each group, every stride-th of all its rows; ``most`` of 0 or less takes all.

    The index counts invalid rows too, as the stride is total div ``most``.
    """
    if most <= 0:
        return df.where(valid)
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    placed = numbered(df, group, order, "_i").join(total.withColumnRenamed(group, "_tg"), F.col(group).eqNullSafe(F.col("_tg"))).drop("_tg")
    stride = F.greatest(F.lit(1), F.floor(F.col("_total") / most))
    hit = placed.where((F.col("_i") % stride == 0) & valid).drop("_i", "_total")
    return first_n(hit, group, [F.col(order)], most)


def first_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the planner keeps only ``n`` rows a group and task before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def random_n(df: DataFrame, group: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each group in the order of a seeded digest of the key."""
    return first_n(df, group, [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)], n)


def shuffled(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """``place``: each row's place in a seeded order of its group; two-level by the digest's first digits, so no group is one task."""
    keyed = df.withColumn("_d", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).withColumn("_r", F.substring("_d", 1, 3))
    counts = keyed.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = keyed.withColumn("_w", F.row_number().over(Window.partitionBy(group, "_r").orderBy("_d", key)) - 1)
    joined = within.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_q")), "left")
    return joined.withColumn("place", F.col("_w") + F.col("_b")).drop("_d", "_r", "_w", "_g", "_q", "_b")


def batches(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``batch_no``: consecutive batches of ``size`` rows of each group, the last one shorter."""
    return numbered(df, group, order, "_i").withColumn("batch_no", F.floor(F.col("_i") / size).cast("bigint")).drop("_i")


def budget_batches(df: DataFrame, group: str, order: str, amount: str, budget: int, width: int = 1 << 20) -> DataFrame:
    """``batch_no``: batches whose elements begin within the same ``budget`` of the group's running sum.

    A batch holds at most ``budget`` and the rest of its last row. Sums are two-level as in :func:`numbered`.
    """
    ranged = df.withColumn("_r", F.floor(F.col(order) / width))
    sums = ranged.groupBy(group, "_r").agg(F.sum(amount).alias("_n"))
    before = sums.select(F.col(group).alias("_g"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(group, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.withColumn("_w", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_q")), "left")
    return joined.withColumn("batch_no", F.floor((F.col("_w") + F.col("_b")) / budget).cast("bigint")).drop("_r", "_w", "_g", "_q", "_b")


def running_total(df: DataFrame, group: str, order: str, amount: str, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows before each row of its group, in the order of a column of any kind; rows of equal order in any order.

    Rows are sorted into ranges of group and order, as many as the session has shuffle partitions; ranges are added up first, then each within.
    """
    ranged = cut(df.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(group, "_p").agg(F.sum(amount).alias("_n"))
    before = sums.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(group, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.withColumn("_w", within).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left")
    return joined.withColumn(out, F.col("_w") + F.col("_b")).drop("_p", "_w", "_g", "_q", "_b")
