import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from nyuzi.llm import mixture as M


@given(st.lists(st.integers(1, 100), min_size=1, max_size=12))
def test_pfair_is_never_a_block_off(weights):
    blocks = {f"s{i}": w for i, w in enumerate(weights)}
    total, seen = sum(weights), dict.fromkeys(blocks, 0)
    order = M.pfair(blocks)
    assert [x[0] for x in order] == list(range(total))
    for slot, s, block in order:
        assert block == seen[s]
        seen[s] += 1
        for k, w in blocks.items():
            assert abs(seen[k] * total - w * (slot + 1)) < total
    assert seen == blocks


def test_ranges_repeat_and_blocks_stay_small():
    sizes = {"a": 7e12, "b": 2.9e12, "c": 5.0, "none": 0.0}
    plan = M.Schedule.of(sizes)
    assert plan.ranges == math.ceil(9.9e12 / M.SLOTS / M.BLOCK) and len(plan.slots) <= M.SLOTS + 3 and set(plan.blocks) == {"a", "b", "c"}
    assert all(sizes[s] / plan.ranges / k <= M.BLOCK for s, k in plan.blocks.items())
    assert M.Schedule.of({}).slots == []


def test_unfilled_blocks_of_many_ranges(spark):
    wanted, has = {"a": 1000.0, "b": 500.0, "c": 10.0}, {"a": 1000.0, "b": 350.0, "c": 0.0}
    got = M.unfilled(spark, wanted, has, most=0.01).groupBy("source").sum("lacking").collect()
    assert {r[0]: round(r[1], 6) for r in got} == {"b": 150.0, "c": 10.0}


def test_plan_fills_up_from_the_others():
    plan = M.plan_shares({"a": 100, "b": 100, "c": 10}, {"a": (0.4, 1), "b": (0.4, 2), "c": (0.2, 2)}, 210.0)
    assert plan["c"]["drawn"] == 20 and plan["a"]["drawn"] == 95 and plan["b"]["drawn"] == 95
    plan = M.plan_shares({"a": 10}, {"a": (1.0, 2), "z": (0.5, 3), "n": (None, None)}, 100.0)
    assert plan["a"]["drawn"] == 20 and plan["z"]["drawn"] == plan["n"]["drawn"] == 0


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs = [(i, "neno " * rng.randint(1, 30), rng.choice(["big", "big", "big", " Mid ", "BIG", "small"] if i % 40 else ["small"])) for i in range(600)]
    docs += [(1000, None, "big"), (1001, "", "big"), (1002, "neno", None), (1003, "neno neno", "stray"), (None, "neno", "big"), (5, "neno", "big")]
    targets = [("big", 0.4, 1), ("Mid", 0.3, 3), ("small", 0.3, 1), ("absent", 0.0, 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")


def test_mixture_keeps_shares_and_caps(tables):
    docs, targets = tables
    size = M.source_plan(docs, targets)[2]
    placed, plan = M.mix(docs, targets, block=size / 200)
    rows = placed.collect()
    total = sum(r["tokens"] for r in rows)
    drawn = sum(v["drawn"] for v in plan.values())
    biggest = 200
    for s, cap in (("big", 1), ("mid", 3), ("small", 1)):
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["tokens"] for r in mine) - plan[s]["drawn"]) <= biggest
        times = {}
        for r in mine:
            times[(r["doc_id"], r["tokens"])] = times.get((r["doc_id"], r["tokens"]), 0) + 1
        assert max(times.values()) <= cap and {r["copy"] for r in mine} <= set(range(cap))
    assert {r["source"] for r in rows} == {"big", "mid", "small"}
    ordered = sorted(rows, key=lambda r: (r["slot"], r["place"]))
    block, seen = drawn / 200, 0.0
    for i, r in enumerate(ordered):
        seen += r["tokens"]
        if i % 50 == 49:
            for s in ("big", "mid", "small"):
                got = sum(x["tokens"] for x in ordered[: i + 1] if x["source"] == s)
                assert abs(got - plan[s]["drawn"] / drawn * seen) <= 3 * block + 3 * biggest
    assert math.isclose(total, drawn, rel_tol=0.05)


def test_short_sources_against_plain_sums(tables):
    docs, targets = tables
    enc = M.encoding()
    size, total = {}, 0
    for r in docs.collect():
        n = len(enc.encode_ordinary(r["text"])) if r["text"] else 0
        total += n
        s = (r["source"] or "").strip().lower()
        size[s] = size.get(s, 0) + n
    want = {t["source"] for t in targets.collect() if size.get(t["source"].lower(), 0) * t["max_repeats"] < t["target_weight"] * total}
    assert {r["source"] for r in M.short_sources(docs, targets).collect()} == want == {"small"}
    assert [r["source"] for r in M.short_sources(docs, targets, block=7).collect()] == ["small"]
    shares = {r["source"]: r for r in M.share_report(docs, targets).collect()}
    assert shares["small"]["short"] and not shares["big"]["short"] and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9


def test_short_by_one_token(spark):
    docs = spark.createDataFrame([(1, "a " * 50, "x"), (2, "a " * 49, "y"), (3, "a", "z")], "doc_id long, text string, source string")
    n = {r["source"]: r["tokens"] for r in M.count_tokens(docs, ["source"]).collect()}
    total = sum(n.values())
    for more, want in ((0.0, []), (0.9, ["x"])):
        targets = spark.createDataFrame([("x", (n["x"] + more) / total, 1), ("y", 0.1, 1)], "source string, target_weight double, max_repeats int")
        assert [r["source"] for r in M.short_sources(docs, targets).collect()] == want


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([("x", 1.0, 2)], "source string, target_weight double, max_repeats int")
    assert M.short_sources(docs, targets).count() == 0 and M.share_report(docs, targets).first()["tokens_drawn"] == 0
    assert M.mix(docs, targets.limit(0))[0].count() == 0


def test_whole_texts_are_counted(spark):
    docs = spark.createDataFrame([(1, "neno " * 200_000), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in M.count_tokens(docs, ["doc_id"]).collect()}
    assert got == {1: len(M.encoding().encode_ordinary("neno " * 200_000)), 2: 0}
