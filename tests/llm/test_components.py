import random

from pyspark.sql import functions as F

from nyuzi.llm import components, prefix
from nyuzi.operators import sampling


def test_running_sums_and_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    got = prefix.running_sum(df, ["g"], F.col("i"), "n", "at", buckets=8).collect()
    assert len(got) == 400
    for g in ("a", "b", None):
        mine = sorted((r["at"], r["n"]) for r in got if r["g"] == g)
        starts = {at for at, _ in mine}
        assert 0 in starts and max(at + n for at, n in mine) == sum(n for _, n in mine)
    numbered = sampling.numbered(df, "g", "i", "k", width=50).collect()
    for g in ("a", "b", None):
        assert [r["k"] for r in sorted((r for r in numbered if r["g"] == g), key=lambda r: r["i"])] == list(range(sum(x[0] == g for x in rows)))


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    links = chain + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x"), ("q", "p"), ("p", "r")]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"x": "x", "y": "x", "p": "p", "q": "p", "r": "p"}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
