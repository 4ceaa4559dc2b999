"""The queries of the text and audio operators; each runs over its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nyuzi.llm import chunking, groups, leakage, mixture, mojibake, overlap, reading, unify
from nyuzi.session import AUDIO_BATCHES, computed, cut, scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings over 17,500 samples, and whether all needed cuts can lie in pauses."""
    return computed(chunking.oversized(table(spark, sf_dir, "omni_corpus"), ["row_id"]), "long", AUDIO_BATCHES)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every readable recording."""
    pieces = chunking.split_audio(table(spark, sf_dir, "omni_corpus"), ["row_id"])
    return pieces.select("row_id", "piece_no", "start", "stop", "cut_kind", F.md5("piece_bytes").alias("piece_md5"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_clips").select(F.lit("raw_clips").alias("table_name"), "row_id", F.col("transcription").alias("text"))
    omni = table(spark, sf_dir, "omni_corpus").select(F.lit("omni_corpus").alias("table_name"), "row_id", "text")
    return raw.unionByName(omni)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of omni_corpus whose text is not in clean form, without those holding garbled letters."""
    odd = unify.unify(table(spark, sf_dir, "omni_corpus"), ["row_id"]).where("changed").select("row_id")
    garbled = mojibake.find_garbled(_texts(spark, sf_dir), ["table_name", "row_id"]).where("table_name = 'omni_corpus'")
    return odd.join(garbled.select("row_id"), "row_id", "left_anti")


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of omni_corpus in one form."""
    return unify.unify(table(spark, sf_dir, "omni_corpus"), ["row_id"]).select("row_id", "clean_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw_clips and omni_corpus whose text holds garbled letters."""
    return mojibake.find_garbled(_texts(spark, sf_dir), ["table_name", "row_id"]).select("table_name", "row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their texts with what can be restored."""
    return mojibake.restore(_texts(spark, sf_dir), ["table_name", "row_id"])


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """All records of omni_corpus in two deliveries, those written before the middle of its time and the rest; and the ties of their clips' speakers."""
    omni, said = table(spark, sf_dir, "omni_corpus"), table(spark, sf_dir, "utterances")
    at = F.col("written_at").cast("timestamp")
    t = omni.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    early = F.coalesce(at < F.lit(t["low"] + (t["high"] - t["low"]) / 2), F.lit(False)) if t["low"] else F.lit(False)
    return [groups.utterance_speakers(omni.where(part), said) for part in (early, ~early)], groups.clip_ties(omni, said)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers tied to others by a shared sentence, with their group, from the table that two deliveries leave."""
    parts, ties = _deliveries(spark, sf_dir)
    return groups.tied_speakers(groups.deliver_components(parts, scratch_path(spark, "components"), ties))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, ties = _deliveries(spark, sf_dir)
    parts = [cut(part) for part in parts]
    placed = cut(groups.deliver(parts, scratch_path(spark, "splits"), ties=ties)[0])
    return groups.one_side(parts[0].unionByName(parts[1]), placed)[0]


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of omni_corpus with its group and split after two deliveries; groups that the second joined across splits, and records of
    a short sentence whose speaker lies on another side, are in quarantine."""
    return _placed(spark, sf_dir)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups of each split."""
    placed = _placed(spark, sf_dir)
    per_group = placed.groupBy("split", "group").agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows and dev or test rows with the same or nearly the same sentence."""
    pairs = overlap.cross_split_pairs(table(spark, sf_dir, "utterances"), "utt_id", "text", "split")
    return pairs.select(F.col("id_a").alias("utt_id_a"), F.col("id_b").alias("utt_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows found in train, by split and source."""
    return overlap.overlap_report(table(spark, sf_dir, "utterances"), "utt_id", "text", "split", "source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a run of an evaluation item."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that hold it."""
    return leakage.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay below their target even when used up."""
    return mixture.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.share_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself, record by record, with its slot."""
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at level 4 or 5."""
    return reading.demanding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated level of every document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_unified, p3_found, p3_restored, p4_found, p4_splits, p4_shares, p5_found, p5_report,
        p7_found, p7_report, p8_found, p8_shares, p8_mixture, p9_found, p9_levels,
    )
}
#: None of these can be put in SQL over whole tables: audio bytes, Unicode forms, encodings, edit distance, tokenizers, propagation.
ORACLES: dict[str, str] = {}
