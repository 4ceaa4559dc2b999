"""Resumable ingestion and the checkpoint watcher on Structured Streaming."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import paths


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, key: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, suffix: str = "*.parquet", time: str | None = None, late: str = "1 day") -> None:
    """Takes the files that arrived since the last call, transforms them and appends them to ``sink``; then stops.

    The checkpoint is the log of what is done: a run that failed is repeated, a file is never taken twice. With ``key`` a row delivered
    again is dropped: with a ``time`` column through streaming state that is given up ``late`` after it, else by what the sink holds already, so no
    state grows with the stream. The sink must then have the key.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", suffix).parquet(source)
    if key and time:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    if transform:
        stream = transform(stream)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if key and not time:

        def append_new(batch: DataFrame, _: int) -> None:
            new = batch.dropDuplicates([key])
            try:
                held = batch.sparkSession.read.parquet(sink).select(F.col(key).alias("_held"))
                new = new.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
            except AnalysisException:  # nothing is there yet
                pass
            new.write.mode("append").parquet(sink)

        writer = writer.foreachBatch(append_new)
    else:
        writer = writer.format("parquet").option("path", sink)
    writer.start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and group of a stream; rows later than the watermark are dropped with their state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select("w.start", group, "n")


def steps_in(files: DataFrame) -> DataFrame:
    """``step, path, size`` of finished step folders in numeric order; names that are no number are left out."""
    return files.select(paths.step_number(F.col("path")).alias("step"), "path", "size").where("step IS NOT NULL").orderBy("step", "path")


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of the later listing whose size did not change since the earlier."""
    return after.join(before.select("path", F.col("size").alias("_was")), "path").where(F.col("size") == F.col("_was")).drop("_was")


def mismatched(local: DataFrame, remote: DataFrame, key: str = "name") -> DataFrame:
    """``key, size, remote_size`` of copies that are absent or of another size."""
    out = local.join(remote.select(key, F.col("size").alias("remote_size")), key, "left")
    return out.where(F.col("remote_size").isNull() | (F.col("remote_size") != F.col("size"))).select(key, "size", "remote_size")


def local_path(path: str) -> str:
    """A path of the shared file system as Python opens it."""
    return path.removeprefix("file://").removeprefix("file:")


def make_folder(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def copy_file(source: str, target: str) -> int:
    """Copies one file between paths of any file system that Arrow knows, under another name until it is whole; the size of the copy is returned."""
    files, at = fs.FileSystem.from_uri(source) if ":" in source else (fs.LocalFileSystem(), source)
    to, name = fs.FileSystem.from_uri(target) if ":" in target else (fs.LocalFileSystem(), target)
    to.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with files.open_input_stream(at) as x, to.open_output_stream(name + ".part") as y:
        shutil.copyfileobj(x, y, 8 << 20)
    to.move(name + ".part", name)
    return to.get_file_info(name).size


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, poll: str | None = None, upload: Callable[[str, str], int] = copy_file):
    """Copies every new file of finished step folders to ``target``; returns the query.

    A batch lists names and sizes only. Files that have grown since the batch was listed, and copies of another size than their file, raise, so the batch's
    offsets are not committed and the next start repeats it. Without ``poll`` what is there now is taken and the query ends.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(schema).load(source)
    files = stream.select("path", F.col("length").alias("size"))

    def one_batch(batch: DataFrame, _: int) -> None:
        def run(rows):
            for b in rows:
                got = [upload(p, f"{target}/step_{s}/{p.rsplit('/', 1)[-1]}") for s, p in zip(b["step"], b["path"])]
                yield b.assign(copied=got)

        ready = steps_in(batch).select("step", "path", "size").persist()
        try:
            now = batch.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", F.col("length").alias("size"))
            growing = ready.join(stable(ready, now).select("path"), "path", "left_anti").select("path").limit(5).collect()  # names for the message
            if growing:
                raise OSError(f"files still growing: {[r['path'] for r in growing]}")
            done = ready.mapInPandas(run, "step long, path string, size long, copied long").persist()
            wrong = mismatched(done.select(F.col("path").alias("name"), "size"), done.select(F.col("path").alias("name"), F.col("copied").alias("size"))).limit(5).collect()
            done.unpersist()
            if wrong:
                raise OSError(f"copies of the wrong size: {[r['name'] for r in wrong]}")
        finally:
            ready.unpersist()

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one_batch)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def keep_watching(spark: SparkSession, source: str, target: str, checkpoint: str, pause: float = 60.0, cycles: int | None = None, upload: Callable[[str, str], int] = copy_file, say: Callable[[str], None] = print) -> int:
    """:func:`watch` again and again, with ``pause`` seconds between; a cycle that fails is told and repeated by the next. Returns how many failed."""
    failed = n = 0
    while cycles is None or n < cycles:
        n += 1
        try:
            watch(spark, source, target, checkpoint, upload=upload).awaitTermination()
        except StreamingQueryException as e:
            failed += 1
            say(str(e).splitlines()[0])
        if cycles is None or n < cycles:
            time.sleep(pause)
    return failed
