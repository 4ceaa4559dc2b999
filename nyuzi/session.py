"""Session helpers: tables by name, and a shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: For functions that get recordings. Spark keeps a batch twice in buffers that double as they grow, outside the heap, and Python once or twice, for each task.
AUDIO_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Settings that suit large clusters; pass them to the session's builder, with partition counts of your own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) is a folder of our own made, and only
    for a local master, since a machine's own folder is of no use to other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="nyuzi-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once and cuts its lineage; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for a table that is written and read again; the file system deletes it when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark).rstrip('/')}/scratch-{sc.applicationId}"
    at = sc._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def computed(df: DataFrame, label: str, settings: dict[str, str]) -> DataFrame:
    """``df`` computed once under settings of its own, in a copy of its session, and read again from a scratch table; its session stays as it is.

    The table has as many files as its size asks for, not one a task: without Hadoop's native library each file costs some launches of ``chmod``.
    """
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    for key, value in settings.items():
        own.conf().set(key, value)
    at = scratch_path(spark, label)
    spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df.hint("rebalance")._jdf.queryExecution().logical()).write().parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, unless they find it on their path already."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or (sc.master.startswith("local[") and Path.cwd().resolve() == root) or getattr(sc, "_nyuzi_shipped", False):
        return
    from pyspark import SparkFiles

    target = Path(SparkFiles.getRootDirectory()) / "nyuzi.zip"  # Spark's own folder on the driver, from which executors fetch
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "nyuzi").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._nyuzi_shipped = True
