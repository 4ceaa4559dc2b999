"""Sinks: Parquet tables and partitioned corpora, JSON documents and logs, CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nyuzi.sources import readers


def table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def corpus(df: DataFrame, root: str, version: int = 0, name: str = "corpus", mode: str = "append") -> None:
    """Folders ``version=/corpus=/split=/language=``; rows are brought together by split and language, spread over files by size.

    A large language is rebalanced into several files, so none becomes one task's burden.
    """
    out = df.withColumn("version", F.lit(version)).withColumn("corpus", F.lit(name)).hint("rebalance", "split", "language")
    out.write.mode(mode).option("compression", "zstd").partitionBy("version", "corpus", "split", "language").parquet(root)


def split_descriptors(assigned: DataFrame, path: str) -> None:
    """A JSON line a language: rows, dev rows, sorted dev speakers."""
    docs = assigned.groupBy("language").agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("is_dev"), F.col("n"))), F.lit(0)).alias("dev_rows"), F.array_sort(F.collect_list(F.when(F.col("is_dev"), F.col("speaker")))).alias("dev_speakers")
    )
    docs.write.mode("overwrite").partitionBy("language").json(path)


def progress(df: DataFrame, path: str) -> None:
    """Units done, appended to the log."""
    df.select("src", "rows", "hours").write.mode("append").json(path)


def submission(df: DataFrame, path: str, placeholder: str = ".") -> None:
    """``id, language, transcription`` appended, every file with its header; no transcription is empty."""
    text = F.coalesce(F.nullif(F.col("transcription"), F.lit("")), F.lit(placeholder))
    df.select("id", "language", text.alias("transcription")).write.mode("append").option("header", True).option("escape", '"').csv(path)


def resume_submission(df: DataFrame, path: str, exists: bool) -> int:
    """Appends the rows whose ids earlier output does not hold; returns how many."""
    new = readers.pending(df, readers.submission(df.sparkSession, path), "id") if exists else df
    new = new.persist()
    n = new.count()
    if n:
        submission(new, path)
    new.unpersist()
    return n


def states(df: DataFrame, path: str) -> None:
    """Model states ``ckpt, key, is_float, values`` as one Parquet table, by checkpoint."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("ckpt").parquet(path)


def card(path: str, name: str, family: str, root: str, tokenizer: str) -> None:
    """A small YAML descriptor of a dataset for a trainer; its keys are fixed values of the trainer's format."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"name: {name}\ndataset_family: {family}\ndataset_config:\n  data: {root}\ntokenizer_ref: {tokenizer}\n")


def report(df: DataFrame, digits: int = 4) -> list[str]:
    """Lines of a small grouped result, numbers with a fixed count of digits; for people, so at most a thousand rows."""
    kinds = dict(df.dtypes)
    shown = df.select(*[F.format_number(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in df.columns])
    return ["\t".join(df.columns)] + ["\t".join("-" if v is None else v for v in r) for r in shown.limit(1000).collect()]


def csv_report(df: DataFrame, path: str) -> None:
    """A report as CSV files, each with its header."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
