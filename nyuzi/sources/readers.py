"""Readers: listings, manifests, archives, partitioned corpora, logs and earlier output."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import paths
from nyuzi.operators import mixing

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("audio_filepath", "transcription", "voice_creator_id", "speaker_id")])
PROGRESS = T.StructType([T.StructField("src", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("hours", T.DoubleType())])
SUBMISSION = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "language", "transcription")])
SPLIT_DESCRIPTOR = T.StructType([T.StructField("total_rows", T.LongType()), T.StructField("dev_rows", T.LongType()), T.StructField("dev_speakers", T.ArrayType(T.StringType()))])
#: Largest batch of archive members handed on at once.
MEMBER_BATCH = 32 << 20


def listing(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """``path, size, modified`` of all files below a folder; contents are never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        r = r.option("pathGlobFilter", f"*{suffix}")
    return r.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def largest_directories(files: DataFrame, n: int = 15) -> DataFrame:
    """``top, files, bytes`` of the ``n`` largest top-level directories of relative paths; a null size counts as 0."""
    sums = files.groupBy(paths.top_directory(F.col("path")).alias("top")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return sums.orderBy(F.desc("bytes"), "top").limit(n)


def parquet(spark: SparkSession, *path: str) -> DataFrame:
    """One or several Parquet paths or globs, with the file each row came from."""
    return spark.read.parquet(*path).withColumn("source_file", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Records of newline-delimited JSON; the schema is given, never inferred, and blank lines are no records."""
    return spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields]).isNotNull())


def json_document(spark: SparkSession, path: str, schema: T.StructType = SPLIT_DESCRIPTOR) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)


def progress_totals(log: DataFrame) -> DataFrame:
    """``done, hours`` of a log; hours that are null count as 0."""
    return log.agg(F.count_distinct("src").alias("done"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """Rows of earlier output, for resuming."""
    return spark.read.schema(SUBMISSION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def corpus(spark: SparkSession, root: str, languages: list[str] | None = None, split: str | None = None) -> DataFrame:
    """A corpus in folders ``version=/corpus=/split=/language=``; languages and split prune folders, not rows."""
    df = spark.read.option("basePath", root).parquet(root)
    if split:
        df = df.where(F.col("split") == split)
    return df.where(F.col("language").isin(languages)) if languages else df


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "member_path", "basename", "content"]
    types = [pa.string(), pa.string(), pa.string(), pa.binary()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for b in batches:
        for path in b.column(0).to_pylist():
            rows, weight = [], 0
            # one pass over the file as it is read: xz streams cannot be sought, and no archive is held in memory
            with fs.FileSystem.from_uri(path)[0].open_input_stream(fs.FileSystem.from_uri(path)[1], compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                for m in tar:
                    if not m.isfile():
                        continue
                    data = tar.extractfile(m).read()
                    rows.append((path, m.name, m.name.rsplit("/", 1)[-1], data))
                    weight += len(data)
                    if weight > MEMBER_BATCH:
                        yield pack(rows)
                        rows, weight = [], 0
            if rows:
                yield pack(rows)


def archive_members(spark: SparkSession, path: str, glob: str = "*.tar*") -> DataFrame:
    """``archive, member_path, basename, content`` of all files inside tar archives, compressed in any way and of any size.

    Spark lists the archives; each is read by one task, as its stream cannot be split, in one sequential pass through Arrow's file systems, a member
    at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    # a task an archive, of the listing alone: contents are not in it
    return files.repartition("path").mapInArrow(_members, "archive string, member_path string, basename string, content binary")


def with_members(records: DataFrame, members: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """Manifest records with the archive member of the same base name; of several the first by path counts.

    Archives are unpacked once: base names meet their members, and a window keeps the first of each record's.
    """
    chosen = members.groupBy("basename").agg(F.min_by(F.struct("archive", "member_path", "content"), F.struct("archive", "member_path")).alias("m")).select("basename", "m.*")
    keyed = records.where(F.col(path).isNotNull() & (F.col(path) != "")).withColumn("basename", paths.basename(F.col(path)))
    return keyed.join(chosen, "basename")


def with_archived(records: DataFrame, members: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """Records of ``category, split, chunk`` with their member of the archive ``category_split_chunk.tar*``."""
    name = F.regexp_replace(paths.basename(F.col("archive")), r"\.tar.*$", "")
    held = members.withColumn("_a", name)
    keyed = records.withColumn("basename", paths.basename(F.col(path))).withColumn("_a", F.concat_ws("_", "category", "split", "chunk"))
    return keyed.join(held, ["_a", "basename"]).drop("_a")


def unmatched(records: DataFrame, members: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """``reason, n``: records without a path, and with one that no member has."""
    named = records.withColumn("basename", paths.basename(F.nullif(F.col(path), F.lit(""))))
    missing = named.where("basename IS NOT NULL").join(members.select("basename").distinct(), "basename", "left_anti")
    return named.where("basename IS NULL").agg(F.lit("no path").alias("reason"), F.count(F.lit(1)).alias("n")).unionByName(missing.agg(F.lit("no member").alias("reason"), F.count(F.lit(1)).alias("n")))


def pending(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return everything.join(done.select(key).distinct(), key, "left_anti")


def states(spark: SparkSession, path: str) -> DataFrame:
    """Model states as :func:`nyuzi.sources.sinks.states` writes them."""
    return spark.read.option("basePath", path).parquet(path)


def averaged(spark: SparkSession, path: str) -> DataFrame:
    """``key, values``: the mean of the states at a path over their checkpoints."""
    return mixing.average_states(states(spark, path))


def row_counts(spark: SparkSession, *path: str) -> DataFrame:
    """``file, n_rows`` of Parquet paths or globs; as no column is asked for, only footers are read."""
    return spark.read.parquet(*path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
