"""Queries of corpus preparation: catalogs, splits, routing, predicates, joins, text repair, sampling, batching, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nyuzi.functions import audio, paths
from nyuzi.functions import text as X
from nyuzi.operators import convert, mixing, sampling, split
from nyuzi.plans.audio_sql import headers
from nyuzi.session import scratch_path, table
from nyuzi.sources import adapters, readers, sinks

CLIP_RATE = 500


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "utterances")


def q01_hours_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a valid label and their hours, by language and split."""
    rows = table(spark, sf_dir, "omni_corpus").where(split.valid_label(F.col("text")))
    return rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.round(F.coalesce(F.sum(F.when(F.col("split") == s, mixing.hours(F.col("audio_size"), CLIP_RATE))), F.lit(0.0)), 9).alias(f"{s}_hours") for s in ("train", "dev")],
        F.round(F.coalesce(F.sum(mixing.hours(F.col("audio_size"), CLIP_RATE)), F.lit(0.0)), 9).alias("total_hours"),
    )


Q01 = """SELECT language, count(*) AS n_rows,
  round(coalesce(sum(audio_size / 500.0::DOUBLE / 3600.0::DOUBLE) FILTER (WHERE split = 'train'), 0), 9) AS train_hours,
  round(coalesce(sum(audio_size / 500.0::DOUBLE / 3600.0::DOUBLE) FILTER (WHERE split = 'dev'), 0), 9) AS dev_hours,
  round(coalesce(sum(audio_size / 500.0::DOUBLE / 3600.0::DOUBLE), 0), 9) AS total_hours
FROM omni_corpus WHERE text IS NOT NULL AND length(text) > 0 GROUP BY language"""


def q02_largest_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of the fifteen largest top directories."""
    clips = table(spark, sf_dir, "raw_clips").select("src_file", F.octet_length("audio.bytes").alias("b"))
    files = clips.groupBy(F.col("src_file").alias("path")).agg(F.sum("b").alias("size"))
    return readers.largest_directories(files)


Q02 = """SELECT split_part(path, '/', 1) AS top, count(*) AS files, sum(coalesce(size, 0))::BIGINT AS bytes
FROM (SELECT src_file AS path, sum(octet_length(audio.bytes)) AS size FROM raw_clips GROUP BY src_file) GROUP BY top ORDER BY bytes DESC, top LIMIT 15"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.histogram(_utterances(spark, sf_dir), F.col("language"), F.col("speaker_id"))


def q03_speaker_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each speaker of each language (A2, P5)."""
    return _histogram(spark, sf_dir)


_HIST = "SELECT language, coalesce(nullif(speaker_id, ''), '__unknown__') AS speaker, count(*) AS n FROM utterances GROUP BY ALL"
ASSIGNED_SQL = f"""SELECT language, speaker, n,
  coalesce(sum(n) OVER (PARTITION BY language ORDER BY md5(speaker || '42'), speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < 0.1::DOUBLE * sum(n) OVER (PARTITION BY language)
  OR row_number() OVER (PARTITION BY language ORDER BY md5(speaker || '42'), speaker) <= 12 AS is_dev FROM ({_HIST})"""


def q04_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group-disjoint split of each language."""
    return split.split_summary(split.dev_speakers(_histogram(spark, sf_dir)))


Q04 = f"""SELECT language, sum(n)::BIGINT AS total_rows, count(*) AS speakers, count(*) FILTER (WHERE is_dev) AS dev_speakers,
  coalesce(sum(n) FILTER (WHERE is_dev), 0)::BIGINT AS dev_rows, round(coalesce(sum(n) FILTER (WHERE is_dev), 0) / sum(n), 9) AS dev_share
FROM ({ASSIGNED_SQL}) GROUP BY language"""


def q05_dev_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dev speakers of each language, sorted, a row each: a language may have any number."""
    return split.dev_speakers(_histogram(spark, sf_dir)).where("is_dev").select("language", "speaker").orderBy("language", "speaker")


Q05 = f"SELECT language, speaker FROM ({ASSIGNED_SQL}) WHERE is_dev ORDER BY language, speaker"


def q06_routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a valid label, routed by the split."""
    u = _utterances(spark, sf_dir).select("language", "speaker_id", "text")
    rows = split.route(u, split.dev_speakers(_histogram(spark, sf_dir)), F.col("language"), F.col("speaker_id")).where(split.valid_label(F.col("text")))
    return rows.groupBy("language", "routed").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("speaker_id").alias("n_speakers"))


Q06 = f"""WITH a AS ({ASSIGNED_SQL})
SELECT u.language, CASE WHEN a.is_dev THEN 'dev' ELSE 'train' END AS routed, count(*) AS n_rows, count(DISTINCT speaker_id) AS n_speakers
FROM utterances u JOIN a ON u.language = a.language AND coalesce(nullif(u.speaker_id, ''), '__unknown__') = a.speaker
WHERE text IS NOT NULL AND length(text) > 0 GROUP BY ALL"""


def q07_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers on both sides of the split: none."""
    u = _utterances(spark, sf_dir).select("language", "speaker_id")
    rows = split.route(u, split.dev_speakers(_histogram(spark, sf_dir)), F.col("language"), F.col("speaker_id"))
    side = lambda s: rows.where(F.col("routed") == s).select("language", split.speaker_or_unknown(F.col("speaker_id")).alias("speaker"))
    return side("dev").intersect(side("train")).agg(F.count(F.lit(1)).alias("n_overlap"))


Q07 = f"""WITH a AS ({ASSIGNED_SQL}), r AS (SELECT u.language, a.speaker, a.is_dev FROM utterances u JOIN a
  ON u.language = a.language AND coalesce(nullif(u.speaker_id, ''), '__unknown__') = a.speaker)
SELECT count(*) AS n_overlap FROM (SELECT language, speaker FROM r WHERE is_dev INTERSECT SELECT language, speaker FROM r WHERE NOT is_dev)"""

LEAST_SAMPLES, MOST_SAMPLES = 1_000, 30_000


def q08_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and skipped rows by reason, with shares."""
    n = F.col("audio_size")
    reason = (
        F.when(F.col("text").isNull(), "null text").when(F.col("text") == "", "empty text").when(n.isNull(), "no size").when(n <= 0, "no audio")
        .when(n < LEAST_SAMPLES, "too short").when(n > MOST_SAMPLES, "too long").otherwise("kept")
    )
    rows = table(spark, sf_dir, "omni_corpus").groupBy("language", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("language")), 9))  # a few rows a language


Q08 = """SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY language), 9) AS share FROM (SELECT language, reason, count(*) AS n_rows FROM (
  SELECT language, CASE WHEN text IS NULL THEN 'null text' WHEN text = '' THEN 'empty text' WHEN audio_size IS NULL THEN 'no size' WHEN audio_size <= 0 THEN 'no audio'
    WHEN audio_size < 1000 THEN 'too short' WHEN audio_size > 30000 THEN 'too long' ELSE 'kept' END AS reason FROM omni_corpus) GROUP BY ALL)"""


def q09_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that no utterance was made of yet, by source."""
    raw = table(spark, sf_dir, "raw_clips").select("source", "clip_id").distinct()
    left = readers.pending(raw, _utterances(spark, sf_dir), "clip_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n_pending"), F.min("clip_id").alias("first_clip"), F.max("clip_id").alias("last_clip"))


Q09 = """SELECT source, count(*) AS n_pending, min(clip_id) AS first_clip, max(clip_id) AS last_clip FROM (SELECT DISTINCT source, clip_id FROM raw_clips) r
WHERE NOT EXISTS (SELECT 1 FROM utterances u WHERE u.clip_id = r.clip_id) GROUP BY source"""


def q10_manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances by source matched to recordings by base name, and those that have none."""
    members = table(spark, sf_dir, "raw_clips").select(paths.basename(F.col("audio.path")).alias("basename")).where("basename IS NOT NULL").distinct()
    records = _utterances(spark, sf_dir).select("source", F.concat(F.lit("audio/"), F.col("clip_id").cast("string"), F.lit(".wav")).alias("audio_filepath"))
    keyed = records.withColumn("basename", paths.basename(F.col("audio_filepath"))).groupBy("source", "basename").agg(F.count(F.lit(1)).alias("n"))
    met = keyed.join(members.withColumn("hit", F.lit(1)), "basename", "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return met.groupBy("source").agg(count(F.col("hit").isNotNull())("n_matched"), count(F.col("hit").isNull())("n_unmatched"))


Q10 = """WITH m AS (SELECT DISTINCT split_part(audio.path, '/', -1) AS b FROM raw_clips WHERE audio.path IS NOT NULL)
SELECT source, count(m.b) AS n_matched, count(*) - count(m.b) AS n_unmatched FROM utterances u LEFT JOIN m ON m.b = u.clip_id::VARCHAR || '.wav' GROUP BY source"""


def q11_pooled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all pools by language, through the language's sources."""
    pools = adapters.pool(
        [
            table(spark, sf_dir, "raw_clips").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.lit("raw")),
            _utterances(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.lit("converted")),
        ]
    )
    return pools.join(F.broadcast(adapters.language_sources(spark)), "source").groupBy("lang", "pool").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"))  # seven rows are broadcast


Q11 = """SELECT lang, pool, sum(n)::BIGINT AS n_rows, count(*) AS n_sources FROM (
  SELECT source, count(*) AS n, 'raw' AS pool FROM raw_clips GROUP BY source UNION ALL SELECT source, count(*), 'converted' FROM utterances GROUP BY source) p
JOIN lang_sources USING (source) GROUP BY lang, pool"""


def q12_column_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with embedded audio as utterances: fallback columns, constants, sentinel."""
    u = adapters.embedded(table(spark, sf_dir, "raw_clips"), "all")
    return u.groupBy("language", split.speaker_or_unknown(F.col("speaker_id")).alias("speaker")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_texts"), F.sum(F.octet_length("audio")).cast("bigint").alias("n_bytes")
    )


Q12 = """SELECT 'all' AS language, coalesce(nullif(speaker_id, ''), '__unknown__') AS speaker, count(*) AS n_rows, count(transcription) AS n_texts,
  sum(octet_length(audio.bytes))::BIGINT AS n_bytes FROM raw_clips GROUP BY ALL"""


def q13_double_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions with the known double-encoded letters put right."""
    t = F.col("transcription")
    return table(spark, sf_dir, "raw_clips").where(t.isNotNull()).select("row_id", X.repair_pairs(t).alias("repaired"), (X.repair_pairs(t) != t).alias("changed"))


_REPAIR = "transcription"
for _wrong, _right in X.DOUBLE_ENCODED:
    _REPAIR = f"replace({_REPAIR}, '{_wrong}', '{_right.replace(chr(39), chr(39) * 2)}')"
Q13 = f"SELECT row_id, {_REPAIR} AS repaired, {_REPAIR} <> transcription AS changed FROM raw_clips WHERE transcription IS NOT NULL"


def sql_normalize(t: str) -> str:
    return sql_collapse(f"regexp_replace(lower(coalesce({t}, '')), '{X.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ' ', 'g')")


def sql_collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{X.SPACE}+', ' ', 'g'))"


def sql_words(t: str) -> str:
    return f"list_filter(string_split({sql_collapse(t)}, ' '), lambda w: w <> '')"


def q14_normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring form and word count of every utterance."""
    n = X.normalize(F.col("text"))
    return _utterances(spark, sf_dir).select("utt_id", n.alias("normalized"), F.size(X.words(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_words"), F.size(X.words(n)).cast("bigint").alias("n_normalized"))


Q14 = f"""SELECT utt_id, {sql_normalize('text')} AS normalized, len({sql_words("coalesce(text, '')")})::BIGINT AS n_words,
  len({sql_words(sql_normalize('text'))})::BIGINT AS n_normalized FROM utterances"""


def q15_tag_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with annotation tags and with double-encoded letters, by language."""
    t = F.col("text")
    u = _utterances(spark, sf_dir).where(split.valid_label(t))
    return u.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(X.has_tag(t).cast("double")), 9).alias("tag_share"),
        F.round(F.avg((X.repair_pairs(t) != t).cast("double")), 9).alias("garbled_share"),
        F.sum(F.char_length(t) - F.char_length(X.strip_tags(t))).cast("bigint").alias("stripped"),
    )


_REPAIR_TEXT = _REPAIR.replace("transcription", "text")
Q15 = f"""SELECT language, count(*) AS n_rows, round(avg(regexp_matches(text, '{X.TAG}')::INT), 9) AS tag_share, round(avg(({_REPAIR_TEXT} <> text)::INT), 9) AS garbled_share,
  sum(length(text) - length({sql_collapse(f"regexp_replace(text, '{X.TAG}', ' ', 'g')")}))::BIGINT AS stripped
FROM utterances WHERE text IS NOT NULL AND length(text) > 0 GROUP BY language"""


def q20_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 100 valid rows of each language, spread over all of it."""
    u = _utterances(spark, sf_dir).select("language", "utt_id", "text")
    return sampling.stride_sample(u, "language", "utt_id", split.valid_label(F.col("text")), 100)


Q20 = """WITH a AS (SELECT language, utt_id, text, row_number() OVER (PARTITION BY language ORDER BY utt_id) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM utterances),
b AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY utt_id) AS k FROM a WHERE i % greatest(1, n // 100) = 0 AND text IS NOT NULL AND length(text) > 0)
SELECT language, utt_id, text FROM b WHERE k <= 100"""


def q21_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five and five random valid rows of each language."""
    u = _utterances(spark, sf_dir).where(split.valid_label(F.col("text"))).select("language", "utt_id", "text")
    first = sampling.first_n(u, "language", [F.col("utt_id")], 5).withColumn("kind", F.lit("first"))
    return first.unionByName(sampling.random_n(u, "language", "utt_id", 5).withColumn("kind", F.lit("random")))


Q21 = """WITH v AS (SELECT language, utt_id, text FROM utterances WHERE text IS NOT NULL AND length(text) > 0)
SELECT language, utt_id, text, 'first' AS kind FROM v QUALIFY row_number() OVER (PARTITION BY language ORDER BY utt_id) <= 5
UNION ALL SELECT language, utt_id, text, 'random' FROM v QUALIFY row_number() OVER (PARTITION BY language ORDER BY md5(utt_id::VARCHAR || '0'), utt_id) <= 5"""


def q22_mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each language and its sampling weight at three temperatures."""
    hours = mixing.hours_table(table(spark, sf_dir, "omni_corpus"), "language", "split", "audio_size", CLIP_RATE)
    return mixing.temperature_weights(hours, "train_hours", (0.5, 0.2, 0.1))


Q22 = """WITH h AS (SELECT language, round(coalesce(sum(audio_size / 500.0::DOUBLE / 3600.0::DOUBLE) FILTER (WHERE split = 'train'), 0), 9) AS train_hours,
  round(coalesce(sum(audio_size / 500.0::DOUBLE / 3600.0::DOUBLE) FILTER (WHERE split = 'dev'), 0), 9) AS dev_hours FROM omni_corpus GROUP BY language),
w AS (SELECT *, train_hours / sum(train_hours) OVER () AS s FROM h)
SELECT language, train_hours, dev_hours, round(train_hours + dev_hours, 9) AS total_hours, round(pow(s, 0.5) / sum(pow(s, 0.5)) OVER (), 9) AS weight_0_5,
  round(pow(s, 0.2) / sum(pow(s, 0.2)) OVER (), 9) AS weight_0_2, round(pow(s, 0.1) / sum(pow(s, 0.1)) OVER (), 9) AS weight_0_1 FROM w"""


def q25_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of every clip at 16 kHz: count, first and last length."""
    n = (F.col("audio_size") * 32).cast("bigint")
    rows = table(spark, sf_dir, "omni_corpus").where("audio_size IS NOT NULL").select("row_id", n.alias("n"), audio.chunk_count(n).alias("n_chunks"), audio.chunk_lengths(n).alias("c"))
    return rows.select("row_id", "n", "n_chunks", F.element_at("c", 1).alias("first_length"), F.element_at("c", -1).alias("last_length"), F.round(F.col("n") / 16000, 6).alias("duration"))


Q25 = """SELECT row_id, n, CASE WHEN n <= 632000 THEN 1 ELSE ceil(n / 560000) END::INT AS n_chunks, CASE WHEN n < 32000 THEN 32000 WHEN n <= 632000 THEN n ELSE 560000 END::BIGINT AS first_length,
  CASE WHEN n < 32000 THEN 32000 WHEN n <= 632000 THEN n ELSE n - (ceil(n / 560000) - 1) * 560000 END::BIGINT AS last_length, round(n / 16000, 6) AS duration
FROM (SELECT row_id, (audio_size * 32)::BIGINT AS n FROM omni_corpus WHERE audio_size IS NOT NULL)"""


def q26_ordered_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document exploded with their number and joined again in order."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    joined = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("t"))
    return joined.select("doc_id", "n_lines", F.md5("t").alias("text_md5"))


Q26 = r"SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, md5(array_to_string(string_split(text, chr(10)), ' ')) AS text_md5 FROM documents"


def q27_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight clips of each file, with the rows of each."""
    clips = sampling.batches(table(spark, sf_dir, "raw_clips").select("src_file", "row_id"), "src_file", "row_id", 8)
    return clips.groupBy("src_file", "batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


Q27 = """SELECT src_file, batch_no, count(*) AS n_rows, min(row_id) AS first_row, max(row_id) AS last_row FROM (
  SELECT src_file, row_id, (row_number() OVER (PARTITION BY src_file ORDER BY row_id) - 1) // 8 AS batch_no FROM raw_clips) GROUP BY src_file, batch_no"""


def q27_running_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative hours of the progress log in the order of its units."""
    log = table(spark, sf_dir, "progress_log").groupBy("src").agg(F.coalesce(F.max("hours"), F.lit(0.0)).alias("hours"))
    rows = sampling.running_total(log.withColumn("dir", paths.top_directory(F.col("src"))), "dir", "src", "hours", "before")
    return rows.select("src", F.round("hours", 6).alias("hours"), F.round(F.col("before") + F.col("hours"), 6).alias("cum_hours"))


Q27B = """SELECT src, round(hours, 6) AS hours, round(sum(hours) OVER (PARTITION BY split_part(src, '/', 1) ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_hours
FROM (SELECT src, coalesce(max(hours), 0) AS hours FROM progress_log GROUP BY src)"""


def q28_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a language by the running sum of samples, 150,000 each."""
    rows = table(spark, sf_dir, "omni_corpus").where("audio_size > 0").select("language", "row_id", "audio_size")
    return sampling.budget_batches(rows, "language", "row_id", "audio_size", 150_000).groupBy("language", "batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("audio_size").cast("bigint").alias("n_samples")
    )


Q28 = """SELECT language, batch_no, count(*) AS n_rows, sum(audio_size)::BIGINT AS n_samples FROM (
  SELECT language, audio_size, (coalesce(sum(audio_size) OVER (PARTITION BY language ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 150000)::BIGINT AS batch_no
  FROM omni_corpus WHERE audio_size > 0) GROUP BY language, batch_no"""


def q29_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every source file's path."""
    p = F.col("src_file")
    number = F.regexp_extract(paths.basename(p), r"batch([0-9]+)-", 1)
    files = table(spark, sf_dir, "raw_clips").select("src_file").distinct()
    return files.select(
        "src_file", paths.basename(p).alias("base"), paths.top_directory(p).alias("top"), paths.parent(p, 2).alias("third_last"), paths.flat_name(p).alias("flat"),
        p.endswith(".parquet").alias("is_parquet"), number.rlike("^[0-9]+$").alias("numbered"), F.when(number != "", number.cast("bigint")).alias("number"),
    )


Q29 = """SELECT src_file, split_part(src_file, '/', -1) AS base, split_part(src_file, '/', 1) AS top, nullif(split_part(src_file, '/', -3), '') AS third_last, replace(src_file, '/', '__') AS flat,
  src_file LIKE '%.parquet' AS is_parquet, regexp_matches(n, '^[0-9]+$') AS numbered, try_cast(nullif(n, '') AS BIGINT) AS number
FROM (SELECT DISTINCT src_file, regexp_extract(split_part(src_file, '/', -1), 'batch([0-9]+)-', 1) AS n FROM raw_clips)"""


def q31_payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by the form of their payload (B1)."""
    b = F.col("audio_bytes")
    return table(spark, sf_dir, "omni_corpus").groupBy("language", audio.payload_kind(b).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length(b)), F.lit(0)).cast("bigint").alias("n_bytes"))


Q31 = """SELECT language, CASE WHEN audio_bytes IS NULL OR octet_length(audio_bytes) = 0 THEN 'empty' WHEN substr(hex(audio_bytes), 1, 8) = '52494646' THEN 'raw'
  WHEN substr(hex(audio_bytes), 1, 8) = '556B6C47' THEN 'base64' ELSE 'other' END AS kind, count(*) AS n_rows, coalesce(sum(octet_length(audio_bytes)), 0)::BIGINT AS n_bytes
FROM omni_corpus GROUP BY ALL"""


def q31_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable recordings, their rates and samples, from headers alone."""
    rows = table(spark, sf_dir, "omni_corpus").select("language", "audio_size", audio.read_header("audio_bytes").alias("h"))
    return rows.groupBy("language", "h.ok", "h.error").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h.frames").alias("n_samples"), F.count_if(F.col("h.frames") != F.col("audio_size")).alias("n_wrong_size"))


Q31B = headers("omni_corpus", "audio_bytes", "language, audio_size") + """SELECT language, ok, error, count(*) AS n_rows, sum(frames)::BIGINT AS n_samples, count(*) FILTER (WHERE frames <> audio_size) AS n_wrong_size
FROM wavs GROUP BY ALL"""


def q31_flac_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the converted utterances from their FLAC headers, inside code generation."""
    b = F.col("audio_flac")
    rows = _utterances(spark, sf_dir).where(audio.is_flac(b)).select("language", audio.flac_rate(b).alias("rate"), audio.flac_samples(b).alias("n"))
    return rows.groupBy("language", "rate").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_samples"), F.round(F.sum(F.col("n") / F.col("rate") / 3600), 9).alias("hours"))


Q31C = """SELECT language, rate, count(*) AS n_rows, sum(n)::BIGINT AS n_samples, round(sum(n / rate / 3600), 9) AS hours FROM (
  SELECT language, ('0x' || substr(hex(audio_flac), 37, 5))::BIGINT AS rate, ('0x' || substr(hex(audio_flac), 44, 9))::BIGINT AS n FROM utterances
  WHERE substr(hex(audio_flac), 1, 8) = '664C6143' AND octet_length(audio_flac) >= 26) GROUP BY language, rate"""


def q35_partitioned_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written in folders by split and language, and read back pruned to dev and two languages."""
    root = scratch_path(spark, "corpus")
    rows = table(spark, sf_dir, "omni_corpus").where(split.valid_label(F.col("text"))).select("row_id", "text", "audio_size", "split", "language")
    sinks.corpus(rows, root)
    back = readers.corpus(spark, root, ["kik", "luo"], "dev")
    return back.select("row_id", F.md5("text").alias("text_md5"), F.coalesce("audio_size", F.lit(-1)).alias("audio_size"), "language")


Q35 = "SELECT row_id, md5(text) AS text_md5, coalesce(audio_size, -1) AS audio_size, language FROM omni_corpus WHERE text IS NOT NULL AND length(text) > 0 AND split = 'dev' AND language IN ('kik', 'luo')"

def q38_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw clips converted to FLAC at 16 kHz, and what each file gave."""
    clips = table(spark, sf_dir, "raw_clips").select("src_file", F.col("audio.bytes").alias("payload"))
    return convert.unit_summary(convert.convert(clips, ["src_file"], "payload"), "src_file")


Q38 = headers("raw_clips", "audio.bytes", "src_file") + """SELECT src_file, count(*) AS n_rows, count(*) FILTER (WHERE is_wav) AS n_kept, count(*) FILTER (WHERE NOT is_wav) AS n_skipped,
  round(coalesce(sum(n16), 0) / 16000 / 3600, 9) AS hours FROM wavs GROUP BY src_file"""


def q39_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All utterances in a seeded order, by position."""
    u = _utterances(spark, sf_dir).select("language", "utt_id")
    return sampling.shuffled(u, "language", "utt_id", "7").groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("utt_id", "place").alias("first_utt"), F.max("place").alias("last_place"))


Q39 = """SELECT language, count(*) AS n_rows, arg_min(utt_id, place) AS first_utt, max(place) AS last_place FROM (
  SELECT language, utt_id, row_number() OVER (PARTITION BY language ORDER BY md5(utt_id::VARCHAR || '7'), utt_id) - 1 AS place FROM utterances) GROUP BY language"""

QUERIES = {
    f.__name__: f
    for f in (
        q01_hours_by_language, q02_largest_directories, q03_speaker_histogram, q04_split_summary, q05_dev_speakers, q06_routed_counts, q07_split_overlap, q08_reject_reasons, q09_pending,
        q10_manifest_match, q11_pooled_sources, q12_column_fallback, q13_double_encoding, q14_normalized_tokens, q15_tag_prevalence, q20_stride_sample, q21_examples, q22_mixture_weights,
        q25_chunk_plan, q26_ordered_regroup, q27_batches, q27_running_hours, q28_budget_batches, q29_paths, q31_payload_kinds, q31_headers, q31_flac_hours, q35_partitioned_round_trip, q38_convert, q39_shuffled,
    )
}
ORACLES = {
    "q01_hours_by_language": Q01, "q02_largest_directories": Q02, "q03_speaker_histogram": _HIST, "q04_split_summary": Q04, "q05_dev_speakers": Q05, "q06_routed_counts": Q06,
    "q07_split_overlap": Q07, "q08_reject_reasons": Q08, "q09_pending": Q09, "q10_manifest_match": Q10, "q11_pooled_sources": Q11, "q12_column_fallback": Q12, "q13_double_encoding": Q13,
    "q14_normalized_tokens": Q14, "q15_tag_prevalence": Q15, "q20_stride_sample": Q20, "q21_examples": Q21, "q22_mixture_weights": Q22, "q25_chunk_plan": Q25, "q26_ordered_regroup": Q26,
    "q27_batches": Q27, "q27_running_hours": Q27B, "q28_budget_batches": Q28, "q29_paths": Q29, "q31_payload_kinds": Q31, "q31_headers": Q31B, "q31_flac_hours": Q31C, "q38_convert": Q38, "q35_partitioned_round_trip": Q35, "q39_shuffled": Q39,
}
