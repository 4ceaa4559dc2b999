import base64
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import wav as make

from nyuzi.functions import wav
from nyuzi.llm import chunking as C

SMALL = C.Limits(limit=100, overlap=10, pause=8, quiet=0.1)


def clip(n, gaps, loud=100, rest=0):
    x = np.array([loud if i % 2 else -loud for i in range(n)], float)
    for a, b in gaps:
        x[a:b] = 0
    return x + rest


def feasible(n, gaps, rules):
    """Brute force: can any chain of cuts inside pauses do?"""
    spots = sorted({i for a, b in gaps if b - a >= rules.pause for i in range(a, b + 1)})
    reach = {c for c in spots if rules.overlap <= c <= rules.limit}
    done = set()
    while reach:
        if any(n - c <= rules.limit - rules.overlap for c in reach):
            return True
        done |= reach
        reach = {c for c in spots if c not in done and any(d < c <= d + rules.limit - rules.overlap for d in reach)}
    return False


def check(n, cuts, rules):
    starts, stops = [0, *(c - rules.overlap for c in cuts)], [*cuts, n]
    assert all(0 <= a < b and b - a <= rules.limit for a, b in zip(starts, stops))
    assert stops == sorted(set(stops))


def test_against_brute_force():
    rng = random.Random(5)
    kinds = set()
    for _ in range(600):
        n = rng.randint(90, 600)
        gaps, at = [], 0
        while (at := at + rng.randint(5, 90)) < n - 12:
            gaps.append((at, at + rng.randint(4, 12)))
            at = gaps[-1][1]
        cuts, kind = C.plan_cuts(clip(n, gaps), SMALL)
        check(n, cuts, SMALL)
        kinds.add(kind)
        assert kind == ("whole" if n <= SMALL.limit else "pause" if feasible(n, gaps, SMALL) else "forced")
        if kind == "pause":
            assert all(any(a <= c <= b for a, b in gaps if b - a >= SMALL.pause) for c in cuts)
    assert kinds == {"whole", "pause", "forced"}


def test_pieces_are_balanced_where_pauses_allow():
    n = 250
    cuts, kind = C.plan_cuts(clip(n, [(i, i + 10) for i in range(5, 240, 20)]), SMALL)
    sizes = [b - a for a, b in zip([0, *(c - 10 for c in cuts)], [*cuts, n])]
    assert kind == "pause" and len(sizes) == 3 and max(sizes) - min(sizes) <= 20


def test_resting_level_and_silence():
    assert C.plan_cuts(clip(250, [(i, i + 10) for i in range(5, 240, 20)], rest=37), SMALL)[1] == "pause"
    assert C.plan_cuts(np.zeros(250), SMALL)[1] == "pause"
    assert C.plan_cuts(np.zeros(0), SMALL) == ([], "whole")
    assert C.plan_cuts(clip(100, []), SMALL) == ([], "whole") and C.plan_cuts(clip(101, []), SMALL)[1] == "forced"


def test_rows_of_all_kinds(spark):
    x = np.clip(clip(250, [(80, 95), (150, 170)]), -100, 100)
    raw = make(x)
    rows = [(1, raw, 0), (2, base64.encodebytes(raw), 7), (3, raw[:20], 1), (4, b"", 1), (5, None, 1), (6, b"noise", 1), (7, make(x, 16), 1), (8, make(x, size=0xFFFFFFFF), 1), (9, make(x[:50]), 9999), (1, raw, 0), (None, raw, 0)]
    df = spark.createDataFrame(rows, "row_id long, audio_bytes binary, audio_size long")
    got = C.cut_plan(df, ["row_id"], rules=SMALL).collect()
    assert sorted((r["row_id"] or 0, r["n_samples"], r["cut_kind"]) for r in got) == [(0, 250, "pause"), (1, 250, "pause"), (1, 250, "pause"), (2, 250, "pause"), (7, 250, "pause"), (8, 250, "pause"), (9, 50, "whole")]
    assert sorted(r["row_id"] or 0 for r in C.oversized(df, ["row_id"], rules=SMALL).collect()) == [0, 1, 1, 2, 7, 8]


def test_pieces_join_to_the_whole(spark):
    rng = np.random.default_rng(3)
    clips = {i: rng.integers(-100, 100, n) for i, n in enumerate((30, 100, 101, 333))}
    df = spark.createDataFrame([(i, make(x, b)) for b in (8, 16) for i, x in ((i + b, x) for i, x in clips.items())], "row_id long, audio_bytes binary")
    got = sorted(C.split_audio(df, ["row_id"], rules=SMALL).collect(), key=lambda r: (r["row_id"], r["piece_no"]))
    for row_id, pieces in itertools.groupby(got, key=lambda r: r["row_id"]):
        whole = []
        for p in pieces:
            raw = bytes(p["piece_bytes"])
            s = wav.samples(raw, wav.header(raw)).tolist()
            assert len(s) == p["stop"] - p["start"] <= SMALL.limit
            assert not whole or whole[-SMALL.overlap :] == s[: SMALL.overlap]
            whole = whole[: p["start"]] + s
        assert whole == clips[row_id % 8].tolist()


def test_unreadable_widths_and_a_very_long_clip(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal(3_000_000) * 3000).astype(np.int16)
    x[::40_000] = 0
    for at in range(15_000, len(x), 15_000):
        x[at : at + 200] = 0
    long = wav.write(500, 1, 16, x.tobytes())
    odd = wav.write(500, 1, 16, b"\0" * 80_000, 3)
    df = spark.createDataFrame([(1, long), (2, odd), (3, b"junk"), (4, None)], "row_id long, audio_bytes binary")
    got = {r["row_id"]: r for r in C.cut_plan(df, ["row_id"]).collect()}
    assert set(got) == {1} and got[1]["cut_kind"] == "pause" and got[1]["n_samples"] == len(x)
    ends = [0, *got[1]["cuts"], len(x)]
    assert all(b - a <= 17_500 - (500 if a else 0) for a, b in zip(ends[:-1], ends[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_pauses_do_not_depend_on_the_width_of_samples(seed):
    x = np.random.default_rng(seed).integers(-30, 31, 4000)
    x[500:900] //= 15
    a, b = C.pauses(x.astype(np.float32), C.Limits(pause=5)), C.pauses(x.astype(np.float64), C.Limits(pause=5))
    assert all((p == q).all() for p, q in zip(a, b))


def sent_to_python(df):
    """Bytes that Python workers got for ``df``, after it has run."""
    node = df._jdf.queryExecution().executedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    return node.metrics().apply("pythonDataSent").value()


def test_short_payloads_do_not_go_to_python(spark):
    rng = np.random.default_rng(7)
    short = [(i, make(rng.integers(-100, 100, 50)), 9999) for i in range(200)]
    edge = [(1000, make(clip(100, []))), (1001, make(clip(101, []))), (1002, base64.encodebytes(make(clip(101, [])))), (1003, make(clip(101, []), 16)), (1004, None), (1005, b"x" * 500)]
    df = spark.createDataFrame(short + [(k, raw, 0) for k, raw in edge], "row_id long, audio_bytes binary, audio_size long").coalesce(1)
    got = C.oversized(df, ["row_id"], rules=SMALL)
    assert sorted(r["row_id"] for r in got.collect()) == [1001, 1002, 1003]
    assert sent_to_python(got) < 5_000 < sum(len(raw) for _, raw, _ in short)


def test_batches_of_recordings_are_bounded(spark, tmp_path, monkeypatch):
    from nyuzi.llm import queries

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([str(b.num_rows)])], names=["row_id", "cut_kind"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.range(40).selectExpr("id row_id", "unhex(repeat('52', 1000000)) audio_bytes").coalesce(1).write.parquet(f"{tmp_path}/omni_corpus.parquet")
    monkeypatch.setattr(queries.chunking, "oversized", lambda df, keys: df.select(*keys, "audio_bytes").mapInArrow(sizes, "row_id long, cut_kind string"))
    got = queries.p1_found(spark, str(tmp_path))
    rows = got.collect()
    assert sum(int(r["cut_kind"]) for r in rows) == 40 and max(r["row_id"] for r in rows) < 10_000_000
    assert spark.conf.get(key) == before
    got.createOrReplaceTempView("long_recordings")
    assert spark.sql("select count(*) n from long_recordings").first()["n"] == len(rows)


def test_a_small_result_is_not_spread_over_a_file_a_task(spark, tmp_path):
    from nyuzi.llm import queries

    raw = make(clip(17_600, [(9_000, 9_400)]))
    spark.createDataFrame([(i, raw) for i in range(40)], "row_id long, audio_bytes binary").repartition(20).write.parquet(f"{tmp_path}/omni_corpus.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")
    try:
        assert spark.read.parquet(f"{tmp_path}/omni_corpus.parquet").rdd.getNumPartitions() > 8
        queries.p1_found(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(i, "pause") for i in range(40)]
