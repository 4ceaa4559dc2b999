"""Sources of different shape brought to one utterance table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTTERANCE = T.StructType(
    [T.StructField("audio", T.BinaryType()), *(T.StructField(c, T.StringType()) for c in ("text", "speaker_id", "split", "domain", "language"))]
)
# Language codes and the source directories that feed each.
LANGUAGE_SOURCES = {"swa": ("swa",), "kik": ("kik",), "luo": ("luo",), "som": ("som_maxatire", "som_mogadishu"), "mas": ("mas",), "kln": ("kln",)}


def language_sources(spark: SparkSession) -> DataFrame:
    """``lang, source``: seven rows."""
    return spark.createDataFrame([(lang, s) for lang, sources in LANGUAGE_SOURCES.items() for s in sources], "lang string, source string")


def first_existing(df: DataFrame, names: list[str], default: Column) -> Column:
    """The first of the columns that the table has, else the default. Settled when the plan is built."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), default)


def payload(df: DataFrame, name: str) -> Column:
    """The bytes of an audio column, be it binary or a struct with a ``bytes`` field."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType):
        return F.col(f"`{name}`.bytes")
    if isinstance(kind, T.BinaryType):
        return F.col(f"`{name}`")
    raise TypeError(f"{name} is neither binary nor a struct of bytes")


def embedded(df: DataFrame, language: str) -> DataFrame:
    """A table with audio inside it as utterances; absent columns become empty texts, nulls stay null."""
    empty = F.lit("")
    audio = "audio" if "audio" in df.columns else "audio_bytes"
    return df.select(
        payload(df, audio).alias("audio"),
        first_existing(df, ["transcription"], empty).alias("text"),
        first_existing(df, ["recorder_uuid", "speaker_id"], empty).alias("speaker_id"),
        first_existing(df, ["split"], empty).alias("split"),
        first_existing(df, ["domain"], empty).alias("domain"),
        F.lit(language).alias("language"),
    )


def pool(tables: list[DataFrame]) -> DataFrame:
    """All rows of several tables of one shape."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
