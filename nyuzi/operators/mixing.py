"""Hours by language and temperature weights; means of vectors by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours(samples: Column, rate: float) -> Column:
    return samples / F.lit(float(rate)) / F.lit(3600.0)


def hours_table(df: DataFrame, language: str, split: str, samples: str, rate: float, sides: tuple[str, ...] = ("train", "dev")) -> DataFrame:
    """``language``, hours of each side and their total."""
    wide = df.groupBy(language).agg(*[F.round(F.coalesce(F.sum(F.when(F.col(split) == s, hours(F.col(samples), rate))), F.lit(0.0)), 9).alias(f"{s}_hours") for s in sides])
    return wide.withColumn("total_hours", F.round(sum((F.col(f"{s}_hours") for s in sides[1:]), F.col(f"{sides[0]}_hours")), 9))


def temperature_weights(table: DataFrame, amount: str, betas: tuple[float, ...]) -> DataFrame:
    """``weight_b`` for each beta: (share of the amount) ** beta, normalized; 1 is proportional, near 0 equal. A row a language."""
    everything = Window.partitionBy(F.lit(1))
    out = table
    for beta in betas:
        raw = F.pow(F.col(amount) / F.sum(amount).over(everything), F.lit(float(beta)))
        name = f"weight_{str(beta).replace('.', '_')}"
        out = out.withColumn("_w", raw).withColumn(name, F.round(F.col("_w") / F.sum("_w").over(everything), 9)).drop("_w")
    return out


def vector_mean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, pos, mean``: elementwise mean in double precision, one row an element, so long vectors spread over tasks."""
    each = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return each.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def average_states(states: DataFrame) -> DataFrame:
    """``key, values``: states ``ckpt, key, is_float, values`` averaged over checkpoints; other states keep the last checkpoint's.

    Only keys of the first checkpoint are kept; the mean is taken over the checkpoints that hold the key.
    """
    first = states.agg(F.min("ckpt").alias("first"))
    keys = states.join(F.broadcast(first), F.col("ckpt") == F.col("first"), "left_semi").select("key").distinct()  # one row is broadcast
    kept = states.join(keys, "key", "left_semi")
    floats = vector_mean(kept.where("is_float"), "key", "values").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"].cast("float")).alias("values"))
    others = kept.where(~F.col("is_float")).groupBy("key").agg(F.max_by("values", "ckpt").alias("values"))
    return floats.unionByName(others)
