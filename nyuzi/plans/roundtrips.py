"""Queries of readers, sinks and the watcher: what is written to the shared folder comes back as it was; and their SQL."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nyuzi.functions import paths
from nyuzi.functions import text as X
from nyuzi.operators import split
from nyuzi.plans.corpus import ASSIGNED_SQL
from nyuzi.plans.evaluation import Q32
from nyuzi.session import scratch_path, table
from nyuzi.sources import readers, sinks
from nyuzi.streaming import ingest


def q42_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each directory from a recursive listing by suffix."""
    root = scratch_path(spark, "listing")
    table(spark, sf_dir, "lang_sources").repartition(1).write.partitionBy("lang").parquet(root)
    files = readers.listing(spark, root, ".parquet").select(F.regexp_extract("path", r"(lang=[^/]*/[^/]*)$", 1).alias("path"), "size")
    return readers.largest_directories(files).select("top", "files", (F.col("bytes") > 0).alias("has_bytes"))


Q42 = "SELECT 'lang=' || lang AS top, 1::BIGINT AS files, true AS has_bytes FROM lang_sources GROUP BY lang"


def q43_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances written as a JSONL manifest and read with its schema."""
    path = scratch_path(spark, "manifest")
    name = F.concat(F.lit("audio/"), F.col("clip_id").cast("string"), F.lit(".wav"))
    table(spark, sf_dir, "utterances").select(name.alias("audio_filepath"), F.col("text").alias("transcription"), "speaker_id").write.json(path)
    return readers.manifest(spark, path).select("audio_filepath", F.md5("transcription").alias("text_md5"), "speaker_id")


Q43 = """SELECT 'audio/' || clip_id || '.wav' AS audio_filepath, md5(text) AS text_md5, speaker_id FROM utterances
WHERE clip_id IS NOT NULL OR text IS NOT NULL OR speaker_id IS NOT NULL"""


def q44_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission written for one language, resumed for all, and read again: every id once."""
    path = scratch_path(spark, "submission")
    t = X.collapse(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "utterances").select(F.col("utt_id").cast("string").alias("id"), "language", t.alias("transcription"))
    sinks.resume_submission(rows.where("language = 'kik'"), path, False)
    sinks.resume_submission(rows, path, True)
    return readers.submission(spark, path)


Q44 = f"SELECT id::VARCHAR AS id, language, transcription FROM ({Q32})"


def _archive(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of text files by category and split."""
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:xz") as tar:
        for no, text in zip(rows["item_id"], rows["text"]):
            data = text.encode("utf-8")
            info = tarfile.TarInfo(f"files/{no}.txt")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    name = f"{rows['root'].iloc[0]}/{rows['lang'].iloc[0]}_{rows['held_out'].iloc[0]}_0.tar.xz"
    with open(name, "wb") as f:
        f.write(packed.getvalue())
    return pd.DataFrame({"name": [name]})


def q45_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items packed in archives by language and split, found again through a manifest of category, split and chunk."""
    root = ingest.local_path(scratch_path(spark, "archives"))
    ingest.make_folder(root)
    items = table(spark, sf_dir, "eval_items")
    items.withColumn("root", F.lit(root)).groupBy("lang", "held_out").applyInPandas(_archive, "name string").collect()  # a name a group
    manifest = items.select("item_id", F.col("lang").alias("category"), F.col("held_out").alias("split"), F.lit("0").alias("chunk"), F.concat(F.lit("files/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("audio_filepath"))
    met = readers.with_archived(manifest, readers.archive_members(spark, root))
    return met.select("item_id", paths.basename(F.col("archive")).alias("archive"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("content_md5"))


Q45 = "SELECT item_id, lang || '_' || held_out || '_0.tar.xz' AS archive, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS content_md5 FROM eval_items"


def q46_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress log appended to twice and totalled."""
    path, log = scratch_path(spark, "progress"), table(spark, sf_dir, "progress_log")
    for part in (F.col("hours").isNull(), F.col("hours").isNotNull()):
        sinks.progress(log.where(part), path)
    totals = readers.progress_totals(readers.progress(spark, path))
    return totals.select("done", F.round("hours", 6).alias("hours"))


Q46 = "SELECT count(DISTINCT src) AS done, round(coalesce(sum(hours), 0), 6) AS hours FROM progress_log"


def q47_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split descriptors written as JSON documents and read with their schema."""
    path = scratch_path(spark, "descriptors")
    sinks.split_descriptors(split.dev_speakers(split.histogram(table(spark, sf_dir, "utterances"), F.col("language"), F.col("speaker_id"))), path)
    return readers.json_document(spark, path).select("language", "total_rows", "dev_rows", F.explode("dev_speakers").alias("speaker"))


Q47 = f"""WITH a AS ({ASSIGNED_SQL}), s AS (SELECT language, sum(n)::BIGINT AS total_rows, (sum(n) FILTER (WHERE is_dev))::BIGINT AS dev_rows FROM a GROUP BY language)
SELECT language, total_rows, dev_rows, speaker FROM a JOIN s USING (language) WHERE is_dev"""


def q48_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model states written by checkpoint, read again, and averaged by key."""
    path = scratch_path(spark, "states")
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.transform(F.max_by("embedding", "vec_id"), lambda x: x.cast("double")).alias("v"))
    e = e.select(F.col("label").cast("string").alias("ckpt"), F.array(F.struct(F.lit("w").alias("key"), F.lit(True).alias("is_float"), F.col("v").alias("values")), F.struct(F.lit("n").alias("key"), F.lit(False).alias("is_float"), F.array(F.col("n").cast("double")).alias("values"))).alias("s"))
    sinks.states(e.select("ckpt", F.explode("s").alias("s")).select("ckpt", "s.*"), path)
    means = readers.averaged(spark, path)
    return means.select("key", F.posexplode("values").alias("pos", "value")).select("key", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


Q48 = """WITH e AS (SELECT label::VARCHAR AS ckpt, count(*) AS n, arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY label),
w AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e)
SELECT 'w' AS key, pos::INT AS pos, round(avg(x::DOUBLE), 5) AS value FROM w GROUP BY pos UNION ALL SELECT 'n', 0, arg_max(n, ckpt::INT)::DOUBLE FROM e"""


def q49_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished step folders copied by the watcher, verified, and read from the copies."""
    source, target, log = (scratch_path(spark, n) for n in ("steps", "copies", "watch-log"))
    u = table(spark, sf_dir, "utterances").select("utt_id", "language")
    for i, lang in enumerate(("kik", "kln", "luo", "mas", "som", "swa")):
        u.where(F.col("language") == lang).coalesce(1).write.parquet(f"{source}/step_{(i + 1) * 5}")
    u.limit(0).coalesce(1).write.parquet(f"{source}/step_40.tmp")
    ingest.keep_watching(spark, source, target, log, pause=0.0, cycles=2)
    copies = readers.parquet(spark, f"{target}/step_*")
    return copies.groupBy(paths.step_number(F.col("source_file")).alias("step"), "language").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("utt_id").alias("id_sum"))


Q49 = """SELECT list_position(['kik', 'kln', 'luo', 'mas', 'som', 'swa'], language)::BIGINT * 5 AS step, language, count(*) AS n_rows, sum(utt_id)::BIGINT AS id_sum
FROM utterances WHERE language IN ('kik', 'kln', 'luo', 'mas', 'som', 'swa') GROUP BY language"""


def q50_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the largest tables from their footers: no column is read."""
    out = None
    for name in ("raw_clips", "utterances", "omni_corpus", "documents"):
        n = readers.row_counts(spark, f"{sf_dir}/{name}.parquet").agg(F.lit(name).alias("table_name"), F.sum("n_rows").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


Q50 = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("raw_clips", "utterances", "omni_corpus", "documents"))

QUERIES = {f.__name__: f for f in (q42_listing, q43_manifest, q44_submission, q45_archives, q46_progress, q47_descriptors, q48_states, q49_watch, q50_row_counts)}
ORACLES = {
    "q42_listing": Q42, "q43_manifest": Q43, "q44_submission": Q44, "q45_archives": Q45, "q46_progress": Q46, "q47_descriptors": Q47, "q48_states": Q48, "q49_watch": Q49,
    "q50_row_counts": Q50,
}
