import base64
import io
import sys
import wave
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import wav as make

from nyuzi.functions import audio, flac, wav
from nyuzi.operators import convert


def test_header_variants():
    x = [0, 1, -1, 100]
    for raw in (make(x), make(x, extra=b"info"), make(x, extra=b"odd"), make(x, size=0xFFFFFFFF), make(x, size=99)):
        info = wav.header(raw)
        assert info.frames == 4 and list(wav.samples(raw, info)) == x
    assert wav.header(make(x)[:30]) is None and wav.header(b"") is None and wav.header(None) is None and wav.header(b"RIFF") is None
    assert wav.samples(make(x, 16), wav.header(make(x, 16))).tolist() == x


def test_against_the_standard_library():
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(16000)
        w.writeframes(b"\x01\x00\x00\xff\xff\xff" * 5)
    raw = buf.getvalue()
    info = wav.header(raw)
    assert (info.rate, info.channels, info.bits, info.frames) == (16000, 2, 24, 5)
    assert wav.samples(raw, info).tolist() == [0.0] * 5
    assert wav.header(wav.write(500, 1, 8, b"abc")).frames == 3


def test_sniff():
    raw = make([1, 2, 3] * 30)
    text = base64.b64encode(raw)
    assert wav.sniff(raw) == raw and wav.sniff(text) == raw and wav.sniff(base64.encodebytes(raw)) == raw and wav.sniff(base64.urlsafe_b64encode(raw).rstrip(b"=")) == raw
    assert wav.sniff(b"\xff\xfe!") == b"\xff\xfe!" and wav.sniff(None) is None and wav.sniff(b"") == b""


def test_native_and_lenient_sniff(spark):
    rows = [(b"UklGRg==",), (b"UklG Rg==",), (b"RIFFx",), (b"",), (None,), (b"UklG*Rg==",)]
    got = spark.createDataFrame(rows, "b binary").select(audio.sniffed(F.col("b")).alias("n"), audio.sniffed_lenient("b").alias("l")).collect()
    as_bytes = lambda v: None if v is None else bytes(v)
    assert [as_bytes(r["n"]) for r in got] == [b"RIFF", b"RIFF", b"RIFFx", b"", None, b"UklG*Rg=="]
    assert [as_bytes(r["l"]) for r in got] == [b"RIFF", b"RIFF", b"RIFFx", b"", None, b"RIFF"]


def test_flac_header(spark):
    packed = (16000 << 44) | (0 << 41) | (15 << 36) | 123456
    raw = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + packed.to_bytes(8, "big") + bytes(16)
    assert wav.flac_info(raw) == (16000, 123456)
    b = F.col("b")
    got = spark.createDataFrame([(raw,), (b"x",)], "b binary").where(audio.is_flac(b)).select(audio.flac_rate(b), audio.flac_samples(b)).collect()
    assert [tuple(r) for r in got] == [(16000, 123456)]


def test_read_header_tells_what_fails(spark):
    got = spark.createDataFrame([(make([1] * 7),), (b"junk",), (None,)], "b binary").select(audio.read_header("b").alias("h")).select("h.*").collect()
    assert [(r["ok"], r["frames"], r["error"]) for r in got] == [(True, 7, None), (False, None, "unreadable"), (False, None, "empty")]


def test_chunk_lengths(spark):
    want = {0: [32000], 16000: [32000], 32000: [32000], 632000: [632000], 632001: [560000, 72001], 1120001: [560000, 560000, 1]}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", audio.chunk_count(F.col("n")).alias("k"), audio.chunk_lengths(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == want and all(r["k"] == len(r["c"]) for r in got)
    for n in want:
        bounds = audio.slice_bounds(n)
        assert [max(audio.SHORTEST, b - a) if n < audio.SHORTEST else b - a for a, b in zip(bounds[:-1], bounds[1:])] == want[n]


def test_resample_keeps_a_tone():
    t = np.arange(8000) / 8000
    x = audio.resample(np.sin(2 * np.pi * 50 * t), 8000)
    assert len(x) == 16000
    assert np.abs(x[2000:14000] - np.sin(2 * np.pi * 50 * np.arange(16000) / 16000)[2000:14000]).max() < 0.02


def test_transcribe_loses_no_row(spark):
    df = spark.createDataFrame([(1, make([0, 5] * 40)), (2, b"junk"), (3, None)], "id int, audio binary")
    out = audio.transcribe(df, ["id"], "audio", lambda chunks: ["  heard  it " for _ in chunks])
    assert {r["id"]: r["transcription"] for r in out.collect()} == {1: "heard it", 2: ".", 3: "."}


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 4097, 20_000, 4096 * 300 + 5):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        raw = flac.encode(x, 16000)
        assert wav.flac_info(raw) == (16000, n)
        rate, y = flac.decode(raw)
        assert rate == 16000 and (x == y).all()
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


def test_convert_loses_no_row(spark):
    rows = [("a", make([0, 100] * 50)), ("a", base64.b64encode(make([5] * 8))), ("a", b"junk"), ("b", None), ("b", b"")]
    df = spark.createDataFrame(rows, "unit string, payload binary")
    out = convert.convert(df, ["unit"], "payload").cache()
    got = sorted((r["unit"], r["n_samples"] or 0, r["error"] or "") for r in out.collect())
    assert got == [("a", 0, "unreadable"), ("a", 256, ""), ("a", 3200, ""), ("b", 0, "empty"), ("b", 0, "empty")]
    audio_of = next(bytes(r["audio_flac"]) for r in out.collect() if r["n_samples"] == 3200)
    assert flac.decode(audio_of)[0] == 16000
    assert sorted(tuple(r)[:4] for r in convert.unit_summary(out, "unit").collect()) == [("a", 3, 2, 1), ("b", 2, 0, 2)]
    other = convert.convert(df, ["unit"], "payload", decode=lambda b: 1 / 0).collect()
    assert {r["error"] for r in other} == {"ZeroDivisionError", "empty"}


def test_model_gets_bounded_batches_in_order(spark):
    df = spark.createDataFrame([(i, make([1] * (20_000 if i == 3 else 10))) for i in range(11)] + [(99, None)], "id long, audio binary").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def model(chunks):
        assert len(chunks) <= 4
        seen.add(1)
        return [f"{len(c)}" for c in chunks]

    got = {r["id"]: r["transcription"] for r in audio.transcribe(df, ["id"], "audio", model, together=4).collect()}
    assert got == {i: "32000" for i in range(11) if i != 3} | {3: "560000 80000", 99: "."} and seen.value == 3


def test_float_samples():
    import struct

    for bits, code in ((32, "f"), (64, "d")):
        data = struct.pack(f"<3{code}", 0.5, -0.25, 1.0)
        raw = wav.write(500, 1, bits, data, 3)
        assert wav.samples(raw, wav.header(raw)).tolist() == [0.5, -0.25, 1.0]
    assert wav.header(wav.write(500, 1, 16, b"\0" * 8, 3)) is None and wav.header(wav.write(500, 1, 64, b"\0" * 8, 1)) is None


def test_crc_of_all_bytes_together():
    for n in (0, 1, 2, 17, 300, 100):
        data = bytes((7 * i + n) % 256 for i in range(n))
        c = 0
        for b in data:
            c = ((c << 8) & 0xFFFF) ^ flac._CRC16[(c >> 8) ^ b]
        assert flac.crc16(data) == c
