import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from nyuzi.functions import paths
from nyuzi.operators import mixing, sampling, scoring, split


def dev_of(spark, counts):
    hist = spark.createDataFrame([("l", s, n) for s, n in counts.items()], "language string, speaker string, n long")
    return {r["speaker"]: r["is_dev"] for r in split.dev_speakers(hist).collect()}


def greedy(counts):
    import hashlib

    order = sorted(counts, key=lambda s: (hashlib.md5((s + "42").encode()).hexdigest(), s))
    total, taken, dev = sum(counts.values()), 0, set()
    for s in order:
        if taken >= 0.1 * total and len(dev) >= 12:
            break
        dev.add(s)
        taken += counts[s]
    return dev


def test_split_equals_the_greedy_loop(spark):
    rng = random.Random(1)
    for n in (5, 12, 13, 60, 100, 200):
        counts = {f"s{i}": rng.choice([1, 1, 2, 10]) for i in range(n)}
        got = dev_of(spark, counts)
        assert {s for s, d in got.items() if d} == greedy(counts)
    assert sum(dev_of(spark, {f"s{i}": 10 for i in range(5)}).values()) == 5
    assert sum(dev_of(spark, {f"s{i}": 1 for i in range(100)}).values()) == 12
    assert sum(dev_of(spark, {f"s{i}": 1 for i in range(200)}).values()) == 20


def test_route_takes_unknown_speakers_as_a_block(spark):
    df = spark.createDataFrame([("l", None, 1), ("l", "", 2), ("l", "a", 3)], "language string, speaker_id string, v int")
    dev = spark.createDataFrame([("l", "__unknown__", 2, True), ("l", "a", 1, False)], "language string, speaker string, n long, is_dev boolean")
    got = {r["v"]: r["routed"] for r in split.route(df, dev, F.col("language"), F.col("speaker_id")).collect()}
    assert got == {1: "dev", 2: "dev", 3: "train"}


def test_stride_sample(spark):
    def sample(total, most, bad=()):
        df = spark.createDataFrame([("g", i, None if i in bad else "x") for i in range(total)], "g string, i int, t string")
        return sorted(r["i"] for r in sampling.stride_sample(df, "g", "i", split.valid_label(F.col("t")), most).collect())

    assert sample(9962, 1000) == list(range(0, 9000, 9))
    assert sample(1999, 1000) == list(range(1000))
    assert sample(10, 3, bad={3}) == [0, 6, 9]
    assert len(sample(7, 0)) == 7


def test_error_rates_are_corpus_rates(spark):
    pairs = spark.createDataFrame([("l", "a b c", "a x c"), ("l", "d", "d e f"), ("m", "", "a")], "g string, ref string, hyp string")
    got = {r["g"]: r["raw_wer"] for r in scoring.error_rates(pairs, "g", "ref", "hyp").collect()}
    assert got == {"l": 0.75, "m": None}
    tags = spark.createDataFrame([("l", "a [cs] b", "a b")], "g string, ref string, hyp string")
    r = scoring.tag_impact(tags, "g", "ref", "hyp").first()
    assert (r["wer_raw"], r["wer_notags"], r["delta"]) == (round(1 / 3, 9), 0.0, round(1 / 3, 9))


def test_word_diff(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "same", "Same"), (3, "x y", ""), (4, None, "z"), (4, "z", "z z")], "id int, ref string, hyp string")
    got = scoring.word_diff(pairs, ["id"], "ref", "hyp").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, 1, ["b"], ["x"]), (1, 1, 3, 3, [], ["d"]), (3, 0, 0, 0, ["x", "y"], []), (4, 0, 1, 1, [], ["z"])]
    assert scoring.word_diff(pairs.limit(0), ["id"], "ref", "hyp").collect() == []


def test_running_total(spark):
    data = [("ab"[i % 3 == 0], f"{i:03d}", i) for i in range(200)] + [(None, "x", 5), (None, "y", 6)]
    rows = sampling.running_total(spark.createDataFrame(data, "g string, k string, n long"), "g", "k", "n", "sum_before").collect()
    assert len(rows) == len(data) and all(r["sum_before"] == sum(n for g, k, n in data if g == r["g"] and k < r["k"]) for r in rows)


def test_more_tokens_than_one_plane_holds(spark):
    words = [f"w{i}" for i in range(40_000)]
    pairs = spark.createDataFrame([(" ".join(words[:39_990]), " ".join(words[10:]))], "a string, b string")
    from nyuzi.functions import text as X

    assert pairs.limit(0).select(X.token_edits(X.words(F.col("a")), X.words(F.col("b")))).count() == 0
    short = spark.createDataFrame([(0xD7FF - 0x4E00,), (0xD800 - 0x4E00,), (90_000,)], "p long")
    symbols = short.select(X._symbols(F.array(F.col("p")), F.sequence(F.lit(1).cast("long"), F.col("p"))).alias("s")).collect()
    assert [len(r["s"]) for r in symbols] == [1, 1, 1] and len({r["s"] for r in symbols}) == 3


def test_temperature_weights(spark):
    df = spark.createDataFrame([("a", 81.0), ("b", 1.0)], "language string, h double")
    got = {r["language"]: r["weight_0_5"] for r in mixing.temperature_weights(df, "h", (0.5,)).collect()}
    assert got == {"a": 0.9, "b": 0.1}


def test_average_states(spark):
    states = [Row(ckpt=1, key="w", is_float=True, values=[1.0, 2.0]), Row(ckpt=2, key="w", is_float=True, values=[3.0, 4.0]), Row(ckpt=1, key="n", is_float=False, values=[1.0]), Row(ckpt=2, key="n", is_float=False, values=[9.0]), Row(ckpt=2, key="new", is_float=True, values=[1.0])]
    df = spark.createDataFrame(states, "ckpt int, key string, is_float boolean, values array<float>")
    assert {r["key"]: r["values"] for r in mixing.average_states(df).collect()} == {"w": [2.0, 3.0], "n": [9.0]}


def test_paths(spark):
    p = F.col("p")
    r = spark.createDataFrame([("a/b/language=kik/audio_12.tar.xz",)], "p string").select(paths.basename(p), paths.chunk_id(p), paths.extension(p), paths.partition_value(p, "language"), paths.flat_name(p), paths.parent(p, 1), paths.parent(p, 9)).first()
    assert tuple(r) == ("audio_12.tar.xz", "12", ".xz", "kik", "a__b__language=kik__audio_12.tar.xz", "language=kik", None)
