"""Audio of any readable form converted to one: mono, 16 bits, one rate, FLAC."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import audio as A
from nyuzi.functions import flac

#: Bytes of converted audio handed on at once.
BATCH = 32 << 20


def convert(df: DataFrame, carry: list[str], payload: str, decode: Callable[[bytes], np.ndarray] | None = None, rate: int = A.RATE) -> DataFrame:
    """``*carry, audio_flac, n_samples, error``: one row in, one row out, in batches of bounded size.

    ``decode(bytes) -> float samples at rate`` takes other codecs; without it, WAV payloads are read, base64 or not. A row that cannot be read has
    null audio and tells why; it is the caller's to drop and count.
    """
    source = df.select(*carry, payload)
    schema = T.StructType(
        [source.schema[c] for c in carry] + [T.StructField("audio_flac", T.BinaryType()), T.StructField("n_samples", T.LongType()), T.StructField("error", T.StringType())]
    )

    def one(raw):
        if not raw:
            return None, None, "empty"
        try:
            x = decode(raw) if decode else A.waveform(raw, rate)
            if x is None:
                return None, None, "unreadable"
            return flac.encode(np.clip(np.rint(np.asarray(x) * 32768), -32768, 32767).astype(np.int16), rate), len(x), None
        except Exception as e:  # a codec may fail in any way; the row says how
            return None, None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, out, weight = 0, [], 0

            def pack(first, out, b=b):
                held = b.slice(first, len(out))
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))]
                return pa.RecordBatch.from_arrays([*held.columns[: len(carry)], *columns], names=[*carry, "audio_flac", "n_samples", "error"])

            for x in b.column(len(carry)):
                out.append(one(x.as_py()))
                weight += len(out[-1][0] or b"")
                if weight > BATCH:
                    yield pack(first, out)
                    first, out, weight = first + len(out), [], 0
            if out:
                yield pack(first, out)

    return source.mapInArrow(run, schema)


def unit_summary(converted: DataFrame, unit: str, rate: int = A.RATE) -> DataFrame:
    """Rows, kept, skipped and hours of each unit of work."""
    return converted.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("error").isNull()).alias("n_kept"),
        F.count_if(F.col("error").isNotNull()).alias("n_skipped"),
        F.round(F.coalesce(F.sum("n_samples"), F.lit(0)) / F.lit(float(rate)) / 3600, 9).alias("hours"),
    )
