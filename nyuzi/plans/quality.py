"""Queries of the column profile and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nyuzi.operators import profile
from nyuzi.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of raw_clips unlike the others, by column and issue."""
    rows = profile.profile(table(spark, sf_dir, "raw_clips"), "load_id", ["transcription", "speaker_id"], "source")
    return profile.load_issues(rows, "speaker_id", "transcription")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of raw_clips in every load."""
    return profile.profile(table(spark, sf_dir, "raw_clips"), "load_id", None, "source", "loaded_at").withColumnRenamed("grp", "source")


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each induced expression of every column of raw_clips covers in each load, and how that moved since the load before."""
    return profile.coverage(table(spark, sf_dir, "raw_clips"), "load_id", None, "source", "loaded_at").withColumnRenamed("grp", "source")


def p6_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard aggregates of every column of raw_clips in every load."""
    raw = table(spark, sf_dir, "raw_clips")
    counts = profile.value_counts(raw, "load_id", [c for c in raw.columns if c != "load_id"], "source")
    rows = profile.profile_counts(counts, {})
    return rows.select("load_id", "column_name", "n_rows", "n_null", "n_missing", "n_values", "n_distinct", "top_n", F.round("mean_length", 6).alias("mean_length"))


def p6_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The induced expressions of every column of raw_clips that cover at least a hundredth of its rows."""
    raw = table(spark, sf_dir, "raw_clips")
    counts = profile.value_counts(raw, "load_id", [c for c in raw.columns if c != "load_id"])
    out = profile.induce_expressions(counts.where("NOT missing"))
    return out.where("share >= 0.01").select("column_name", "shape", "open", "mixed", "n_values", "n_rows", F.round("share", 9).alias("share"), F.round("bits", 2).alias("bits"))


_STAND_INS = ", ".join("'" + s.replace("'", "''") + "'" for s in profile.STAND_INS)
P6_FOUND = f"""
WITH v AS (
  SELECT load_id, source, 'transcription' AS column_name, transcription AS value FROM raw_clips
  UNION ALL SELECT load_id, source, 'speaker_id', speaker_id FROM raw_clips),
m AS (
  SELECT *, value IS NULL OR NOT regexp_matches(value, '[\\p{{L}}\\p{{N}}]')
    OR lower(regexp_replace(value, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')) IN ({_STAND_INS}) AS gone FROM v),
l AS (
  SELECT load_id, source, column_name, count(*) AS n, count(*) FILTER (WHERE gone) AS lost, count(*) FILTER (WHERE NOT gone) AS kept,
    count(*) FILTER (WHERE NOT gone AND NOT regexp_full_match(value, '[A-Z]{{3}}-[0-9]{{6}}')) AS odd,
    avg(length(value)) FILTER (WHERE NOT gone) AS len FROM m GROUP BY ALL),
t AS (
  SELECT load_id, column_name, max(k) AS top FROM (SELECT load_id, column_name, value, count(*) AS k FROM m WHERE NOT gone GROUP BY ALL) GROUP BY ALL),
s AS (SELECT source, column_name, median(len) AS mid FROM l GROUP BY ALL)
SELECT load_id, column_name, 'missing' AS issue FROM l WHERE lost >= 0.25 * n
UNION ALL SELECT load_id, column_name, 'malformed' FROM l WHERE column_name = 'speaker_id' AND kept >= 20 AND odd >= 0.25 * kept
UNION ALL SELECT l.load_id, l.column_name, 'repeated' FROM l JOIN t USING (load_id, column_name) WHERE l.column_name = 'transcription' AND kept >= 20 AND top >= 0.25 * kept
UNION ALL SELECT load_id, l.column_name, 'shifted' FROM l JOIN s USING (source, column_name) WHERE l.column_name = 'transcription' AND kept >= 20 AND (len < mid / 2 OR len > 2 * mid)
"""

_TEXTS = ("row_id", "clip_id", "source", "src_file", "loaded_at", "recorded_at", "audio.path", "transcription", "speaker_id", "split", "domain")
_GONE = f"""v IS NULL OR NOT regexp_matches(v, '[\\p{{L}}\\p{{N}}]') OR lower(regexp_replace(v, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')) IN ({_STAND_INS})"""
P6_AGGREGATES = f"""
WITH u AS (
  {" UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {c}::VARCHAR AS v, {c}::VARCHAR AS d, length({c}::VARCHAR) AS len FROM raw_clips" for c in _TEXTS)}
  UNION ALL SELECT load_id, 'audio.bytes', hex(audio.bytes[1:4]), md5(audio.bytes), octet_length(audio.bytes) FROM raw_clips),
c AS (SELECT load_id, column_name, v, d, len, {_GONE} AS gone, count(*) AS n FROM u GROUP BY ALL)
SELECT load_id, column_name, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS n_null, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_missing,
  coalesce(sum(n) FILTER (WHERE NOT gone), 0)::BIGINT AS n_values, count(*) FILTER (WHERE NOT gone) AS n_distinct, coalesce(max(n) FILTER (WHERE NOT gone), 0)::BIGINT AS top_n,
  round((sum(n * len) FILTER (WHERE NOT gone)) / (sum(n) FILTER (WHERE NOT gone)), 6) AS mean_length
FROM c GROUP BY load_id, column_name
"""

QUERIES = {f.__name__: f for f in (p6_found, p6_profile, p6_expressions, p6_coverage, p6_aggregates)}
ORACLES = {"p6_found": P6_FOUND, "p6_aggregates": P6_AGGREGATES}
