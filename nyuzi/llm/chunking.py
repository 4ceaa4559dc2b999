"""Oversized recordings cut into pieces under a size limit, in pauses where possible, with a fixed overlap.

Balanced targets: the least number of pieces, equal lengths, each target snapped to the strongest pause nearby; as long as
a limit fails, one piece more. When no count works although a chain of pauses exists, an exact farthest-reach pass
gives the cuts; only without such a chain are cuts forced, at the quietest moment near the target.

Sizes come from the bytes, whatever a size column says. Everything about a row is settled from its own bytes inside one
Arrow pass without a shuffle, so rows of any skew cost what their bytes cost. A batch holds clips up to the session's bound
of bytes a batch (64 MB, in ``p1_found`` 8 MB) or one clip, and one clip at a time is held as samples, in four bytes each up to 16 bits.

Defined results: null, empty and unreadable bytes have no pieces; a clip at or under the limit comes out as one piece; of
pauses equally strong the one nearest the target wins, then the earlier; a clip with no sound at all is one pause; repeated
rows are cut alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nyuzi.functions import wav


class Limits(NamedTuple):
    """Most samples of a piece, samples shared with the piece before, least pause, and what counts as silent."""

    limit: int = 17_500
    overlap: int = 500
    pause: int = 150
    quiet: float = 0.1


def pauses(x: np.ndarray, rules: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pauses, and the loudness of each sample above the resting level (the median)."""
    loud = x - x.dtype.type(np.median(x)) if len(x) else x
    np.abs(loud, out=loud)
    peak = float(loud.max()) if len(loud) else 0.0
    # a float64 bound, whatever the samples are kept in, so that the comparison is not rounded
    quiet = loud < np.float64(rules.quiet * peak) if peak else np.ones(len(x), bool)
    edge = np.flatnonzero(quiet[1:] != quiet[:-1]) + 1
    edge = np.concatenate(([0] if len(x) and quiet[0] else [], edge, [len(x)] if len(x) and quiet[-1] else [])).astype(np.int64)
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= rules.pause
    return start[long], stop[long], loud


def _snap(n: int, k: int, start: np.ndarray, stop: np.ndarray, rules: Limits) -> list[int] | None:
    """Cuts for ``k`` pieces, each in the strongest pause near its balanced target; None if a limit fails."""
    step = rules.limit - rules.overlap
    even = (n + (k - 1) * rules.overlap) / k
    cuts, last = [], 0
    for i in range(1, k):
        low = max(last + 1 if cuts else rules.overlap, n - step * (k - i))
        high = min(last + step if cuts else rules.limit, n - 1)
        target = i * even - (i - 1) * rules.overlap
        near_low, near_high = max(low, target - even / 2), min(high, target + even / 2)
        inside = np.flatnonzero((start <= near_high) & (stop >= near_low))
        if not len(inside):
            return None
        a, b = np.maximum(start[inside], low), np.minimum(stop[inside], high)
        strength = np.minimum(b - a, 2 * rules.pause)
        at = np.clip((start[inside] + stop[inside]) // 2, a, b)
        best = np.lexsort((at, np.abs(at - target), -strength))[0]
        last = int(at[best])
        cuts.append(last)
    return cuts if n - last <= step else None


def _farthest(n: int, start: np.ndarray, stop: np.ndarray, rules: Limits) -> list[int] | None:
    """Cuts that each reach as far as a pause allows: exists whenever any chain of pauses does."""
    step, cuts, last = rules.limit - rules.overlap, [], 0
    while n - last > (step if cuts else rules.limit):
        high = last + step if cuts else rules.limit
        reach = np.minimum(stop[start <= high], high)
        reach = reach[reach > max(last, 0 if cuts else rules.overlap - 1)]
        if not len(reach):
            return None
        last = int(reach.max())
        cuts.append(last)
    return cuts


def plan_cuts(x: np.ndarray, rules: Limits = Limits()) -> tuple[list[int], str]:
    """Where the pieces of a clip end (but the last), and ``whole``, ``pause`` or ``forced``."""
    n, step = len(x), rules.limit - rules.overlap
    if n <= rules.limit:
        return [], "whole"
    start, stop, loud = pauses(x, rules)
    least = 1 + -(-(n - rules.limit) // step)
    for k in range(least, least + len(start) + 1):
        if (cuts := _snap(n, k, start, stop, rules)) is not None:
            return cuts, "pause"
    if (cuts := _farthest(n, start, stop, rules)) is not None:
        return cuts, "pause"
    cuts, last, even = [], 0, (n + (least - 1) * rules.overlap) / least
    around = max(1, min(rules.limit // 20, rules.overlap))
    for i in range(1, least):
        low = max(last + 1 if cuts else rules.overlap, n - step * (least - i))
        high = min(last + step if cuts else rules.limit, n - 1)
        target = int(np.clip(i * even - (i - 1) * rules.overlap, low, high))
        inside = np.flatnonzero((start <= high) & (stop >= low))
        if len(inside):
            at = np.clip((start[inside] + stop[inside]) // 2, np.maximum(start[inside], low), np.minimum(stop[inside], high))
            last = int(at[np.argmin(np.abs(at - target))])
        else:
            a, b = max(low, target - around), min(high, target + around)
            last = int(a + np.argmin(loud[a : b + 1]))
        cuts.append(last)
    return cuts, "forced"


def _read(payload) -> tuple[bytes, wav.WavInfo] | None:
    raw = wav.sniff(payload)
    info = wav.header(raw)
    return None if info is None else (raw, info)


def cut_plan(df: DataFrame, keys: list[str], audio: str = "audio_bytes", rules: Limits = Limits()) -> DataFrame:
    """``keys, n_samples, cut_kind, cuts`` for each readable clip. Clips within the limit are settled from the header alone."""
    source = df.select(*keys, audio)
    schema = T.StructType(
        [source.schema[k] for k in keys]
        + [T.StructField("n_samples", T.LongType()), T.StructField("cut_kind", T.StringType()), T.StructField("cuts", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, kind, cuts = [], [], [], []
            payloads = b.column(b.schema.get_field_index(audio))
            for i in range(b.num_rows):
                if (got := _read(payloads[i].as_py())) is None:
                    continue
                raw, info = got
                c, how = ([], "whole") if info.frames <= rules.limit else plan_cuts(wav.samples(raw, info), rules)
                kept.append(i), size.append(info.frames), kind.append(how), cuts.append(c)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(k)).take(at) for k in keys), pa.array(size, pa.int64()), pa.array(kind, pa.string()), pa.array(cuts, pa.list_(pa.int64()))],
                names=[*keys, "n_samples", "cut_kind", "cuts"],
            )

    return source.mapInArrow(run, schema)


def split_audio(df: DataFrame, keys: list[str], audio: str = "audio_bytes", rules: Limits = Limits()) -> DataFrame:
    """The pieces themselves: ``keys, piece_no, start, stop, cut_kind, piece_bytes`` (WAV in the source's own width).

    Pieces leave the function one clip at a time, so a batch holds no more than one clip's pieces besides its input.
    """
    source = df.select(*keys, audio)
    schema = T.StructType(
        [source.schema[k] for k in keys]
        + [T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("cut_kind", T.StringType()), T.StructField("piece_bytes", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column(b.schema.get_field_index(audio))
            held = [b.column(b.schema.get_field_index(k)) for k in keys]
            out: list[tuple] = []
            weight = 0

            def flush():
                at = pa.array([r[0] for r in out], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(h.take(at) for h in held), *(pa.array([r[j] for r in out], t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.string()), (5, pa.binary())))],
                    names=[*keys, "piece_no", "start", "stop", "cut_kind", "piece_bytes"],
                )

            for i in range(b.num_rows):
                if (got := _read(payloads[i].as_py())) is None:
                    continue
                raw, info = got
                cuts, how = ([], "whole") if info.frames <= rules.limit else plan_cuts(wav.samples(raw, info), rules)
                width = info.channels * info.bits // 8
                for no, (a, z) in enumerate(zip([0, *(c - rules.overlap for c in cuts)], [*cuts, info.frames])):
                    data = raw[info.start + a * width : info.start + z * width]
                    out.append((i, no, a, z, how, wav.write(info.rate, info.channels, info.bits, data, info.kind)))
                    weight += len(data)
                if weight > 16 << 20:
                    yield flush()
                    out, weight = [], 0
            if out:
                yield flush()

    return source.mapInArrow(run, schema)


def oversized(df: DataFrame, keys: list[str], audio: str = "audio_bytes", rules: Limits = Limits()) -> DataFrame:
    """``keys, cut_kind`` of the clips over the limit. A sample takes a byte at least, so payloads of fewer bytes, base64 too, are told without Python."""
    long = df.where(F.octet_length(audio) > rules.limit)
    return cut_plan(long, keys, audio, rules).where(F.col("n_samples") > rules.limit).select(*keys, "cut_kind")
