"""Every query runs over the smallest tables, with stable columns, and does not crash on empty ones."""

import os

import pytest

from nyuzi.llm import queries

COLUMNS = {
    "p1_found": ["row_id", "cut_kind"], "p2_found": ["row_id"], "p3_found": ["table_name", "row_id"], "p4_found": ["speaker_id", "group_id"], "p5_found": ["utt_id_a", "utt_id_b"],
    "p7_found": ["item_id", "doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(rows)) == len(rows)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("raw_clips", "omni_corpus", "utterances", "documents", "eval_items", "mix_targets", "reading_labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(os.path.join(root, f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.fixture(scope="module")
def clashing(spark, sf, tmp_path_factory):
    """The tables with extra columns named like those the operators make inside."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("clash")
    extra = ["token", "core", "key", "kid", "side", "sides", "bucket", "n", "h", "x", "y", "grade", "tokens", "size", "drawn", "at", "copy", "block", "slot", "changed", "clean_text", "clean", "words", "speaker", "sentence", "n_words", "_b", "_h", "cuts", "n_samples"]
    for t in ("raw_clips", "omni_corpus", "utterances", "documents", "eval_items", "mix_targets", "reading_labels"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df.select("*", *[F.lit(1).alias(c) for c in extra if c not in df.columns]).write.parquet(os.path.join(root, f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_clashing_columns(spark, sf, clashing, name):
    assert sorted(map(tuple, queries.QUERIES[name](spark, clashing).collect())) == sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
