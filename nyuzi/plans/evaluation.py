"""Queries of evaluation, submission, latency and averaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nyuzi.functions import audio
from nyuzi.functions import text as X
from nyuzi.operators import mixing, scoring
from nyuzi.plans.audio_sql import headers
from nyuzi.plans.corpus import sql_collapse, sql_normalize, sql_words
from nyuzi.session import scratch_path, table
from nyuzi.streaming import ingest


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, language, ref, hyp``: every corpus row with a label (as hypothesis) beside the label its clip was delivered with.

    Of several deliveries of a clip the first counts.
    """
    ref = table(spark, sf_dir, "utterances").where("text IS NOT NULL AND length(text) > 0").groupBy("clip_id").agg(F.min_by("text", "utt_id").alias("ref"))
    return table(spark, sf_dir, "omni_corpus").select("row_id", "clip_id", "language", F.coalesce("text", F.lit("")).alias("hyp")).join(ref, "clip_id").drop("clip_id")


_PAIRS = """SELECT row_id, o.language, ref, coalesce(o.text, '') AS hyp FROM omni_corpus o
  JOIN (SELECT clip_id, arg_min(text, utt_id) AS ref FROM utterances WHERE text IS NOT NULL AND length(text) > 0 GROUP BY clip_id) USING (clip_id)"""


def _sql_edits(ref: str, hyp: str) -> str:
    """Distance of two token lists: tokens as ASCII characters by their place among the pair's tokens."""
    code = f"list_distinct(list_concat({ref}, {hyp}))"
    one = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: chr(32 + list_position({code}, t)::INT)), ''), '')"
    return f"levenshtein({one(ref)}, {one(hyp)})::BIGINT"


def _sql_counts(prefix: str, ref: str, hyp: str) -> str:
    letters = lambda t: f"string_split({t}, '')"
    return f"""{_sql_edits(sql_words(ref), sql_words(hyp))} AS {prefix}_word_edits, len({sql_words(ref)})::BIGINT AS {prefix}_words,
  {_sql_edits(f"list_filter({letters(ref)}, lambda c: c <> '')", f"list_filter({letters(hyp)}, lambda c: c <> '')")} AS {prefix}_letter_edits, length({ref})::BIGINT AS {prefix}_letters"""


def q16_row_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and letter edits of every pair."""
    return pairs(spark, sf_dir).select("row_id", *scoring.edit_counts(F.col("ref"), F.col("hyp"), "raw"))


Q16 = f"SELECT row_id, {_sql_counts('raw', 'ref', 'hyp')} FROM ({_PAIRS})"


def q17_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus word and letter error rates of each language, raw and normalized."""
    return scoring.error_rates(pairs(spark, sf_dir), "language", "ref", "hyp")


_COUNTED = f"SELECT language, {_sql_counts('raw', 'ref', 'hyp')}, {_sql_counts('norm', 'nref', 'nhyp')} FROM (SELECT *, {sql_normalize('ref')} AS nref, {sql_normalize('hyp')} AS nhyp FROM ({_PAIRS}))"
Q17 = f"""SELECT language, count(*) AS n_rows, {', '.join(f"round(sum({p}_{u}_edits) / nullif(sum({p}_{u}s), 0), 9) AS {p}_{n}" for p in ('raw', 'norm') for u, n in (('word', 'wer'), ('letter', 'cer')))}
FROM ({_COUNTED}) GROUP BY language"""


def q18_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted mean of the languages' rates."""
    return scoring.macro_mean(scoring.error_rates(pairs(spark, sf_dir), "language", "ref", "hyp"))


Q18 = f"SELECT count(*) AS n_groups, round(avg(raw_wer), 9) AS mean_raw_wer, round(avg(norm_wer), 9) AS mean_norm_wer FROM ({Q17})"


def q19_tag_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate with tags in the references and without."""
    return scoring.tag_impact(pairs(spark, sf_dir), "language", "ref", "hyp")


_BARE = sql_collapse(f"regexp_replace(ref, '{X.TAG}', ' ', 'g')")
Q19 = f"""SELECT *, round(wer_raw - wer_notags, 9) AS delta FROM (SELECT language, count(*) AS n_rows, round(sum(e) / nullif(sum(n), 0), 9) AS wer_raw, round(sum(be) / nullif(sum(bn), 0), 9) AS wer_notags FROM (
  SELECT language, {_sql_edits(sql_words('ref'), sql_words('hyp'))} AS e, len({sql_words('ref')}) AS n, {_sql_edits(sql_words('bare'), sql_words('hyp'))} AS be, len({sql_words('bare')}) AS bn
  FROM (SELECT *, {_BARE} AS bare FROM ({_PAIRS}))) GROUP BY language)"""


def q23_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and worst of each group and of all, in one pass."""
    e = table(spark, sf_dir, "events")
    return e.groupingSets([["event_type"], []], "event_type").agg(
        F.grouping_id().cast("int").alias("overall"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_rtf"), F.max("value").alias("max_rtf"), F.round(F.max(F.try_divide("value", F.lit(2.0))), 6).alias("max_half")
    )


Q23 = """SELECT event_type, grouping(event_type)::INT AS overall, count(*) AS n_rows, round(avg(value), 6) AS mean_rtf, max(value) AS max_rtf, round(max(value / 2), 6) AS max_half
FROM events GROUP BY GROUPING SETS ((event_type), ())"""


def q24_vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementwise mean of the vectors of each label."""
    m = mixing.vector_mean(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", "pos", F.round("mean", 6).alias("mean"))


Q24 = """SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos"""


def q30_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column, parsed with a given schema and written again."""
    p = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.to_json(F.struct(p["k"].alias("k"))).alias("again"))


Q30 = """SELECT event_id, (props->>'k')::BIGINT AS k, '{"k":' || (props->>'k') || '}' AS again FROM events"""


def q32_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcription for every id, none empty."""
    t = X.collapse(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "utterances").select(F.col("utt_id").alias("id"), "language", F.coalesce(F.nullif(t, F.lit("")), F.lit(".")).alias("transcription"))


Q32 = f"SELECT utt_id AS id, language, coalesce(nullif({sql_collapse("coalesce(text, '')")}, ''), '.') AS transcription FROM utterances"


def q33_clean_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer output cleaned in both readings of the rule (X2, X3): garbled pairs first made into unknown tokens, as a tokenizer would."""
    t = F.col("transcription")
    unknown = F.regexp_replace(t, "([ÅÄ])[©¨]", "$1 ⁇ ")
    return table(spark, sf_dir, "raw_clips").where(t.isNotNull()).select("row_id", X.clean_prediction(unknown).alias("intended"), X.clean_prediction(unknown, "as_written").alias("as_written"))


def q34_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair does not share, word by word."""
    return scoring.word_diff(pairs(spark, sf_dir), ["row_id"], "ref", "hyp")


def q36_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in by a resumable stream that is started twice, each row once."""
    source = f"{sf_dir}/events.parquet"
    sink, log = scratch_path(spark, "events"), scratch_path(spark, "events-log")
    staged = scratch_path(spark, "events-in")
    df = spark.read.parquet(source)
    df.write.parquet(staged)
    for _ in range(2):
        ingest.ingest_new(spark, staged, df.schema, sink, log, "event_id")
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"), F.sum("user_id").alias("user_sum"))


Q36 = "SELECT event_type, count(*) AS n_rows, count(DISTINCT event_id) AS n_events, sum(user_id)::BIGINT AS user_sum FROM events GROUP BY event_type"


def q37_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model hook over all recordings, with a stand-in that tells each slice's length."""
    return audio.transcribe(table(spark, sf_dir, "omni_corpus"), ["row_id", "language"], "audio_bytes", lambda chunks: [f"{len(c)} samples" for c in chunks])


_PIECES = "array_to_string(list_transform(range(ceil(n16 / 560000)::BIGINT), lambda i: least(560000, n16 - i * 560000) || ' samples'), ' ')"
Q37 = headers("omni_corpus", "audio_bytes", "row_id, language") + f"""SELECT row_id, language,
  CASE WHEN NOT is_wav THEN '.' WHEN n16 < 32000 THEN '32000 samples' WHEN n16 <= 632000 THEN n16 || ' samples' ELSE {_PIECES} END AS transcription FROM wavs"""

QUERIES = {
    f.__name__: f
    for f in (
        q16_row_edits, q17_error_rates, q18_macro_mean, q19_tag_impact, q23_latency, q24_vector_means, q30_json, q32_submission, q33_clean_prediction, q34_word_diff, q36_stream_ingest, q37_transcribe,
    )
}
ORACLES = {
    "q16_row_edits": Q16, "q17_error_rates": Q17, "q18_macro_mean": Q18, "q19_tag_impact": Q19, "q23_latency": Q23, "q24_vector_means": Q24, "q30_json": Q30, "q32_submission": Q32,
    "q36_stream_ingest": Q36, "q37_transcribe": Q37,
}
