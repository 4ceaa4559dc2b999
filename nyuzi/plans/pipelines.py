"""The whole runs: prepare a corpus, evaluate a model, write a submission, measure latency."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import audio
from nyuzi.functions import text as X
from nyuzi.operators import convert, mixing, sampling, scoring, split
from nyuzi.plans.audio_sql import headers
from nyuzi.session import cut, scratch_path, table
from nyuzi.sources import adapters, readers, sinks

Model = Callable[[list], list[str]]


def prepare_corpus(sources: dict[str, list[DataFrame]], root: str, version: int = 0, name: str = "corpus") -> DataFrame:
    """Utterances of each language's sources converted, split by speaker, filtered and written in folders; returns the hours table.

    Speakers are counted before unusable labels are dropped, on rows whose audio can be read, which headers tell. So audio is converted and
    written once, and never kept in between or shuffled for the split: only languages and speakers are.
    """
    pooled = adapters.pool([adapters.pool(t).withColumn("language", F.lit(lang)) for lang, t in sources.items()])
    heads = pooled.select("language", "speaker_id", audio.read_wav_header("audio").alias("ok")).where("ok")
    assigned = cut(split.dev_speakers(split.histogram(heads, F.col("language"), F.col("speaker_id"))))
    done = convert.convert(pooled, ["text", "speaker_id", "language"], "audio").where("error IS NULL").drop("error")
    rows = split.route(done, assigned, F.col("language"), F.col("speaker_id")).where(split.valid_label(F.col("text")))
    out = rows.select("text", F.col("audio_flac").alias("audio_bytes"), F.col("n_samples").alias("audio_size"), F.col("routed").alias("split"), "language")
    sinks.corpus(out, root, version, name)
    return mixing.hours_table(readers.corpus(pooled.sparkSession, root), "language", "split", "audio_size", audio.RATE)


def evaluate(rows: DataFrame, model: Model | None, order: str, most: int = 1000, repair_references: bool = True, load: Callable[[], Model] | None = None) -> DataFrame:
    """Error rates of each language over at most ``most`` rows spread over all of it. ``rows``: ``language, text, audio_bytes`` and ``order``.

    References are repaired like training text unless told otherwise. The mean over languages is :func:`scoring.macro_mean` of the result.
    """
    sample = sampling.stride_sample(rows.select("language", order, "text", "audio_bytes"), "language", order, split.valid_label(F.col("text")), most)
    heard = audio.transcribe(sample, ["language", "text"], "audio_bytes", model, placeholder="", load=load)
    ref = X.fix_double_encoding(F.col("text")) if repair_references else F.col("text")
    pairs = cut(heard.select("language", ref.alias("ref"), X.clean_prediction(F.col("transcription")).alias("hyp")))
    return scoring.error_rates(pairs, "language", "ref", "hyp")


def submit(rows: DataFrame, model: Model | None, path: str, exists: bool, load: Callable[[], Model] | None = None) -> int:
    """Transcribes the ids (``id, audio, language``) that earlier output lacks and appends them; returns how many."""
    new = readers.pending(rows, readers.submission(rows.sparkSession, path), "id") if exists else rows
    new = new.select(F.col("id").cast("string").alias("id"), "language", adapters.payload(new, "audio").alias("audio"))
    heard = audio.transcribe(new, ["id", "language"], "audio", model, load=load)
    text = X.clean_prediction(F.col("transcription"))
    done = cut(heard.select("id", "language", text.alias("transcription")))
    sinks.submission(done, path)
    return done.count()


def latency(rows: DataFrame, key: str, model: Model | None, load: Callable[[], Model] | None = None, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """``id, language, duration_s, latency_s, realtime_factor`` of each readable clip, one model call a clip, timed by ``clock``."""
    source = rows.select(F.col(key).alias("id"), "language", "audio_bytes")
    schema = T.StructType([source.schema["id"], source.schema["language"], *(T.StructField(c, T.DoubleType()) for c in ("duration_s", "latency_s"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = load() if load else model
        for b in batches:
            at, duration, spent = [], [], []
            for i, x in enumerate(b.column(2)):
                if (w := audio.waveform(x.as_py())) is None:
                    continue
                began = clock()
                call([w])
                at.append(i), duration.append(len(w) / audio.RATE), spent.append(clock() - began)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(duration, pa.float64()), pa.array(spent, pa.float64())], names=["id", "language", "duration_s", "latency_s"])

    return source.mapInArrow(run, schema).withColumn("realtime_factor", F.try_divide("latency_s", "duration_s"))


def latency_summary(timed: DataFrame) -> DataFrame:
    """Mean and worst factor of each language and of all (a null language with ``overall`` 1)."""
    return timed.groupingSets([["language"], []], "language").agg(
        F.grouping_id().cast("int").alias("overall"), F.count(F.lit(1)).alias("n_clips"), F.avg("realtime_factor").alias("mean_rtf"), F.max("realtime_factor").alias("max_rtf")
    )


class _Quarters:
    """A clock that goes a quarter of a second further each time it is read."""

    def __init__(self):
        self.n = 0

    def __call__(self) -> float:
        self.n += 1
        return self.n / 4


def q40_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation run with a stand-in model that says how long each slice is; at most 1,000 rows of a language, spread over all of it."""
    rows = table(spark, sf_dir, "omni_corpus").select("language", "row_id", "text", "audio_bytes")
    return evaluate(rows, lambda chunks: [f"{len(c)} Å⁇" for c in chunks], "row_id")


def q41_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time factors of all readable clips with a stand-in model and a stand-in clock, by which every call takes a quarter of a second; written as a
    CSV report, read again, and summed up by language and over all (A9, B7, B11, K7)."""
    path = scratch_path(spark, "latency")
    timed = latency(table(spark, sf_dir, "omni_corpus"), "row_id", lambda chunks: ["" for _ in chunks], clock=_Quarters())
    sinks.csv_report(timed, path)
    rows = spark.read.schema(timed.schema).option("header", True).csv(path)
    total = latency_summary(rows)
    return total.select("language", "overall", "n_clips", F.round("mean_rtf", 6).alias("mean_rtf"), F.round("max_rtf", 6).alias("max_rtf"))


Q41 = headers("omni_corpus", "audio_bytes", "language") + """SELECT language, grouping(language)::INT AS overall, count(*) AS n_clips, round(avg(rtf), 6) AS mean_rtf, round(max(rtf), 6) AS max_rtf
FROM (SELECT language, CASE WHEN n16 > 0 THEN 0.25::DOUBLE / (n16 / 16000) END AS rtf FROM wavs WHERE is_wav) GROUP BY GROUPING SETS ((language), ())"""


QUERIES = {f.__name__: f for f in (q40_evaluate, q41_latency)}
ORACLES = {"q41_latency": Q41}
