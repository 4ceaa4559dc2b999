import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import wav as make

from nyuzi.functions import flac
from nyuzi.operators import scoring
from nyuzi.plans import pipelines
from nyuzi.sources import adapters, readers


def test_prepare(spark, tmp_path):
    def source(lang, n, speakers):
        rows = [(make([0, 9] * 100), None if i % 10 == 9 else f"text {i}", f"{lang}{i % speakers}") for i in range(n)] + [(b"junk", "lost", "x")]
        return adapters.embedded(spark.createDataFrame(rows, "audio_bytes binary, transcription string, speaker_id string"), lang)

    hours = pipelines.prepare_corpus({"kik": [source("a", 100, 50)], "som": [source("b", 30, 5), source("c", 30, 5)]}, str(tmp_path / "c"))
    got = {r["language"]: r for r in hours.collect()}
    back = readers.corpus(spark, str(tmp_path / "c"))
    assert back.count() == 90 + 27 + 27 and set(got) == {"kik", "som"}
    assert abs(got["kik"]["total_hours"] - 90 * 6400 / 16000 / 3600) < 1e-6
    assert got["som"]["train_hours"] == 0 and got["kik"]["train_hours"] > got["kik"]["dev_hours"] > 0
    assert len(flac.decode(bytes(back.first()["audio_bytes"]))[1]) == 6400


def test_evaluate(spark):
    rows = [("kik", i, "mũndũ" if i else None, make([0, 9] * 50)) for i in range(20)] + [("luo", 1, "moja mbili", b"junk")]
    df = spark.createDataFrame(rows, "language string, row_id long, text string, audio_bytes binary")
    rates = pipelines.evaluate(df, lambda chunks: ["mÅ⁇ndÅ⁇" for _ in chunks], "row_id", 5)
    got = {r["language"]: r for r in rates.collect()}
    assert (got["kik"]["n_rows"], got["kik"]["raw_wer"]) == (4, 0.0) and (got["luo"]["n_rows"], got["luo"]["raw_wer"]) == (1, 1.0)
    assert scoring.macro_mean(rates).first()["mean_raw_wer"] == 0.5


def test_submit_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, (make([5] * 40),), "kik"), (2, (b"junk",), "luo")], "id long, audio struct<bytes:binary>, language string")
    path = str(tmp_path / "s")
    assert pipelines.submit(df.where("id = 1"), lambda c: ["  sema " for _ in c], path, False) == 1
    assert pipelines.submit(df, lambda c: ["other" for _ in c], path, True) == 1
    assert sorted(map(tuple, readers.submission(spark, path).collect())) == [("1", "kik", "sema"), ("2", "luo", ".")]


def test_latency(spark):
    df = spark.createDataFrame([(1, "kik", make([5] * 500)), (2, "kik", b"junk"), (3, "luo", make([]))], "id long, language string, audio_bytes binary")
    timed = pipelines.latency(df, "id", None, load=lambda: (lambda chunks: ["x"])).collect()
    assert sorted((r["id"], r["duration_s"], r["realtime_factor"] is None) for r in timed) == [(1, 1.0, False), (3, 0.0, True)]
    total = pipelines.latency_summary(pipelines.latency(df, "id", lambda c: [""])).where("overall = 1").first()
    assert total["n_clips"] == 2 and total["language"] is None and total["mean_rtf"] == pytest.approx(total["max_rtf"])
