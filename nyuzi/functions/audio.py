"""Audio payloads: what can be told natively, and Arrow functions for the rest."""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import wav

# Sampling rate of recognizers, shortest and longest whole clip and length of a slice, in samples.
RATE, SHORTEST, LONGEST, SLICE = 16_000, 32_000, 632_000, 560_000


def payload_kind(b: Column) -> Column:
    """``raw``, ``base64``, ``empty`` or ``other`` from the first bytes alone."""
    head = F.hex(F.substring(b, 1, 4))
    return (
        F.when(b.isNull() | (F.octet_length(b) == 0), "empty").when(head == "52494646", "raw").when(head == "556B6C47", "base64").otherwise("other")
    )


def sniffed(b: Column) -> Column:
    """Payloads that do not start like a WAV file decoded from well-formed base64; others as they are. Inside code generation."""
    text = F.regexp_replace(F.decode(b, "ISO-8859-1"), r"\s", "")
    return F.when(F.hex(F.substring(b, 1, 4)) == "52494646", b).otherwise(F.coalesce(F.try_to_binary(text, F.lit("base64")), b))


@F.pandas_udf(T.BinaryType())
def sniffed_lenient(b: pd.Series) -> pd.Series:
    """As :func:`sniffed` with Python's lenient decoder, which skips characters outside the alphabet."""

    def one(x):
        if x is None or x[:4] == b"RIFF":
            return x
        try:
            return base64.b64decode(x)
        except Exception:
            return x

    return b.map(one)


def flac_rate(b: Column) -> Column:
    """Sample rate of a FLAC header: 20 bits from byte 18 on. Inside code generation."""
    return F.conv(F.substring(F.hex(b), 37, 5), 16, 10).cast("bigint")


def flac_samples(b: Column) -> Column:
    """Total samples of a FLAC header: 36 bits."""
    return F.conv(F.substring(F.hex(b), 44, 9), 16, 10).cast("bigint")


def is_flac(b: Column) -> Column:
    return (F.hex(F.substring(b, 1, 4)) == "664C6143") & (F.octet_length(b) >= 26)


HEADER = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("rate", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("error", T.StringType())])


@F.pandas_udf(HEADER)
def read_header(b: pd.Series) -> pd.DataFrame:
    """Rate and frames of a WAV or FLAC payload without decoding its samples; what cannot be read is told, never raised."""
    out = []
    for x in b:
        raw = wav.sniff(x)
        if (info := wav.header(raw)) is not None:
            out.append((True, info.rate, info.frames, None))
        elif (flac := wav.flac_info(raw)) is not None:
            out.append((True, flac[0], flac[1], None))
        else:
            out.append((False, None, None, "empty" if not x else "unreadable"))
    return pd.DataFrame(out, columns=["ok", "rate", "frames", "error"]).astype({"rate": "Int32", "frames": "Int64"})


@F.pandas_udf(T.BooleanType())
def read_wav_header(b: pd.Series) -> pd.Series:
    """Whether :func:`waveform` can read a payload, from its header alone."""
    return b.map(lambda x: wav.header(wav.sniff(x)) is not None).astype(bool)


def chunk_count(n: Column) -> Column:
    """Slices of a clip of ``n`` samples: the whole up to ``LONGEST``, else consecutive slices, the last one shorter."""
    return F.when(n <= LONGEST, 1).otherwise(F.ceil(n / SLICE)).cast("int")


def chunk_lengths(n: Column) -> Column:
    """Their lengths; a short clip is padded to ``SHORTEST``."""
    cuts = F.transform(F.sequence(F.lit(0), chunk_count(n) - 1), lambda i: F.least(F.lit(SLICE).cast("bigint"), n - i * SLICE))
    return F.when(n < SHORTEST, F.array(F.lit(SHORTEST).cast("bigint"))).when(n <= LONGEST, F.array(n)).otherwise(cuts)


def resample(x: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Linear-phase resampling in the frequency domain; not bit-exact to any one library.

    The clip is padded to a power of two of whole resampling periods, so no length is slow to transform.
    """
    if rate == target or not len(x):
        return x
    g = math.gcd(rate, target)
    periods = 1 << max(0, math.ceil(len(x) * g / rate) - 1).bit_length()
    size, new = periods * (rate // g), periods * (target // g)
    spectrum = np.fft.rfft(x, size)
    return (np.fft.irfft(spectrum[: new // 2 + 1], new) * (new / size))[: round(len(x) * target / rate)]


def slice_bounds(n: int) -> np.ndarray:
    """Where the slices of a clip of ``n`` samples begin, and the end of the last one; as :func:`chunk_count` counts them."""
    return np.array([0, n]) if n <= LONGEST else np.append(np.arange(0, n, SLICE), n)


def waveform(payload: bytes | None, target: int = RATE) -> np.ndarray | None:
    """Mono float samples in [-1, 1] at the target rate; None if the payload cannot be read."""
    raw = wav.sniff(payload)
    info = wav.header(raw)
    if info is None:
        return None
    x = wav.samples(raw, info)
    scale = 1.0 if info.kind == 3 else float(1 << (info.bits - 1))
    return resample(x / scale, info.rate, target).astype(np.float32)


def transcribe(df: DataFrame, keys: list[str], audio: str, model, placeholder: str = ".", load=None, together: int = 8) -> DataFrame:
    """``keys, transcription``: every row in, every row out, whatever fails.

    ``model(list of waveforms) -> list of texts`` is the user's; ``load``, if given, makes it once a task. It gets at most ``together`` slices at a time,
    so no more than those are held as waveforms. The texts of a row's slices are joined with a blank in their order; unreadable audio and empty
    output give the placeholder.
    """
    source = df.select(*keys, audio)
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField("transcription", T.StringType())])

    def waves(payloads: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for row, payload in enumerate(payloads):
            wave = waveform(payload.as_py())
            if wave is not None:
                bounds = slice_bounds(len(wave))
                for begin, end in zip(bounds[:-1], bounds[1:]):
                    piece = wave[begin:end]
                    yield row, piece if len(wave) >= SHORTEST else np.pad(piece, (0, SHORTEST - len(piece)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = load() if load else model
        for b in batches:
            heard = [""] * b.num_rows
            stream = waves(b.column(b.schema.get_field_index(audio)))
            while some := list(itertools.islice(stream, together)):
                rows, pieces = zip(*some)
                for row, text in zip(rows, call(list(pieces))):
                    heard[row] += " " + text
            out = [" ".join(t.split()) or placeholder for t in heard]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(out, pa.string())], names=[*keys, "transcription"])

    return source.mapInArrow(run, schema)
