import random
import re

import pytest
from pyspark.sql import functions as F

from nyuzi.operators import profile as P


def loads(spark, rows):
    return spark.createDataFrame(rows, "load_id string, source string, transcription string, speaker_id string")


def made_up():
    rng = random.Random(4)
    rows = []
    for load in range(12):
        for i in range(40):
            text = " ".join(rng.choice(["moja", "mbili", "tatu", "nne", "Tano,", "sita."]) for _ in range(rng.randint(4, 9)))
            rows.append([f"l{load}", "s", text, f"KIK-{rng.randint(0, 99):06d}"])
    at = lambda load: [r for r in rows if r[0] == f"l{load}"]
    for r in at(1)[:12]:
        r[3] = rng.choice([None, "", "  ", "n/a", "TBD", "--", "NULL"])
    for r in at(2)[:12]:
        r[3] = rng.choice(["kik-000001", "KIK000001", "KIK-00001", "8.0E+00"])
    for r in at(3)[:10]:
        r[2] = "same again and again"
    for r in at(4):
        r[2] = r[2][:4]
    for r in at(5):
        r[2] = r[2] * 4
    for r in at(6)[:9]:
        r[2], r[3] = "?", "kik-1"
    for r in at(7)[:25]:
        r[2] = None
    return [tuple(r) for r in rows]


def test_issues(spark):
    prof = P.profile(loads(spark, made_up()), "load_id", ["transcription", "speaker_id"], "source")
    got = {tuple(r) for r in P.load_issues(prof, "speaker_id", "transcription").collect()}
    assert got == {
        ("l1", "speaker_id", "missing"), ("l2", "speaker_id", "malformed"), ("l3", "transcription", "repeated"), ("l4", "transcription", "shifted"), ("l5", "transcription", "shifted"),
        ("l7", "transcription", "missing"),
    }


def test_induced_expression(spark):
    counts = P.value_counts(loads(spark, made_up()), "load_id", ["transcription", "speaker_id"]).where(~P.is_missing(F.col("value")))
    found = P.main_expressions(counts)
    assert found == {"speaker_id": ["[A-Z]{3}-[0-9]{6}"]}


@pytest.mark.parametrize(
    "values, regex",
    [
        ([f"{i:07d}" for i in range(50)], "[0-9]{7}"),
        ([f"a{'b' * (i % 9)}{i % 3}" for i in range(300)] + [f"user{'x' * (i % 11)}{i}" for i in range(300)], "[a-z]+[0-9]+"),
        ([f"2023-01-{d:02d} {h:02d}:00" for d in range(1, 20) for h in range(24)], "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}"),
        ([f"data/x{i:03d}.(a)" for i in range(80)], r"[a-z]{4}/[a-z][0-9]{3}\.\([a-z]\)"),
    ],
)
def test_expressions_of_columns(spark, values, regex):
    df = spark.createDataFrame([("l", v) for v in values], "load_id string, v string")
    got = P.main_expressions(P.value_counts(df, "load_id", ["v"]))["v"]
    assert got[0] == regex and all(re.fullmatch("|".join(got), v) for v in values)


def test_missing(spark):
    values = {None: True, "": True, " \t": True, "N/A": True, "nan": True, "--": True, "?": True, " ": True, "Unknown ": True, "na": False, "0": False, "ũ": False, "none.": False, "x": False}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", P.is_missing(F.col("v")).alias("m"))
    assert {r["v"]: r["m"] for r in df.collect()} == values


def test_odd_tables(spark):
    assert P.profile(loads(spark, []), "load_id", None, "source").collect() == []
    long = "neno " * 100_000
    rows = [(None, None, long, "A"), (None, None, long + "x", "A"), (None, None, long, None), ("l", "s", None, None), ("l", "s", "b", "b"), ("l", "s", "a", "a")]
    prof = {(r["load_id"], r["column_name"]): r for r in P.profile(loads(spark, rows), "load_id", ["transcription", "speaker_id"], "source").collect()}
    big = prof[(None, "transcription")]
    assert (big["n_rows"], big["n_values"], big["n_distinct"], big["top_n"]) == (3, 3, 2, 2) and abs(big["mean_length"] - 500_000 - 1 / 3) < 1e-6
    assert big["top_value"].startswith("neno neno") and len(big["top_value"]) < 300
    assert (prof[("l", "transcription")]["n_null"], prof[("l", "transcription")]["top_value"], prof[("l", "transcription")]["greatest"]) == (1, "b", "b")


def test_columns_of_every_kind_and_clashing_names(spark):
    df = spark.createDataFrame([("l1", 1, b"RIFFxx", ([1, 2], "p"), {"k": 1}, "v", 2.5)], "load_id string, n int, value binary, `a.b` struct<x:array<int>,y:string>, grp map<string,int>, column_name string, p double")
    got = {r["column_name"]: r for r in P.profile(df, "load_id").collect()}
    assert set(got) == {"n", "value", "a.b", "grp", "column_name", "p"} and got["value"]["least"] == "52494646"
    clips = spark.createDataFrame([("l1", (b"RIFF", "x"))], "load_id string, audio struct<bytes:binary,path:string>")
    assert P.profile(clips, "load_id").first()["least"] == "52494646"


def test_a_hot_load_and_value(spark):
    rows = [("hot", "s", "x y z", "KIK-000001")] * 3000 + [(f"l{i}", "s", f"t {i}", f"KIK-{i:06d}") for i in range(100)]
    r = next(r for r in P.profile(loads(spark, rows), "load_id", ["transcription"], "source").collect() if r["load_id"] == "hot")
    assert (r["n_rows"], r["n_distinct"], r["top_n"]) == (3000, 1, 3000)


def test_binaries_by_all_their_bytes_and_structs_by_field(spark):
    rows = [("l1", (b"RIFF" + bytes([i % 3]) * (100 + i % 3), None if i == 5 else f"p{i}")) for i in range(6)] + [("l2", (b"RIFF", "p")), ("l2", None)]
    df = spark.createDataFrame(rows, "load_id string, audio struct<bytes:binary,path:string>")
    got = {(r["load_id"], r["column_name"]): r for r in P.profile(df, "load_id").collect()}
    assert set(got) == {(load, c) for load in ("l1", "l2") for c in ("audio.bytes", "audio.path")}
    audio, path = got["l1", "audio.bytes"], got["l1", "audio.path"]
    assert (audio["n_distinct"], audio["top_n"], audio["mean_length"], audio["least"]) == (3, 2, 105.0, "52494646") and len(audio["top_value"]) > 40
    assert (path["n_distinct"], path["n_null"], path["least"], path["greatest"]) == (5, 1, "p0", "p4")
    assert (got["l2", "audio.bytes"]["n_null"], got["l2", "audio.path"]["n_null"]) == (1, 1)
    assert abs(got["l2", "audio.bytes"]["length_ratio"] - 4 / 54.5) < 1e-9


def test_long_values_have_expressions_and_others_do_not_conform(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["moja", "mbili,", "tatu", "Nne", "t\u0169.", "saba"]) for _ in range(n)) + " Moja, t\u0169."
    rows = [("ok", "s", text(rng.randint(60, 90)), None) for _ in range(60)] + [("bad", "s", "x\u0169 A, b." * 40 + f"<{i}>" * 9, None) for i in range(20)] + [("blank", "s", " -" * 300, None)]
    got = {r["load_id"]: r for r in P.profile(loads(spark, rows), "load_id", ["transcription"], "source").collect()}
    assert got["ok"]["n_nonconforming"] == 0 and got["ok"]["expression"] not in (None, ".*")
    assert all(re.fullmatch(got["ok"]["expression"].split("|")[0], r[2]) for r in rows[:60])
    assert got["blank"]["n_missing"] == 1
    few = [("a", "s", "".join(chr(rng.randint(33, 126)) for _ in range(80)), None) for i in range(40)]
    got = P.profile(loads(spark, few), "load_id", ["transcription"], "source").first()
    assert got["n_nonconforming"] == got["n_values"] == 40 and got["expression"] is None


def test_ids_that_are_long_have_an_exact_expression(spark):
    df = spark.createDataFrame([("l", "x" * 50 + f"-{i:030d}" + "y" * 300) for i in range(200)] + [("m", "x" * 50 + f"-{i:030d}" + "y" * 299 + "7") for i in range(3)], "load_id string, v string")
    got = {r["load_id"]: r for r in P.profile(df, "load_id").collect()}
    assert got["l"]["expression"] == "[a-z]{50}-[0-9]{30}[a-z]{300}" and (got["l"]["n_nonconforming"], got["m"]["n_nonconforming"]) == (0, 3)


def test_forms_that_come_and_go_show_where_they_do(spark):
    rows = [(f"l{k}", "s", f"{k}-{i}", f"KIK-{i:06d}" if k < 2 or i % 2 else f"kik{i:03d}") for k in range(4) for i in range(40)] + [("l9", "s", None, None)]
    df = loads(spark, rows)
    got = {(r["load_id"], r["expression"]): (r["n_rows"], r["share"], r["step"]) for r in P.coverage(df, "load_id", ["speaker_id"], "source").collect()}
    old, new = "[A-Z]{3}-[0-9]{6}", "[a-z]{3}[0-9]{3}"
    assert got[("l1", old)] == (40, 1.0, 0.0) and got[("l2", old)] == (20, 0.5, -0.5) and got[("l2", new)] == (20, 0.5, 0.5) and got[("l3", new)][2] == 0.0
    assert got[("l0", new)] == (0, 0.0, None) and ("l9", old) not in got
    prof = {r["load_id"]: r["conforming_step"] for r in P.profile(df, "load_id", ["speaker_id"], "source").collect()}
    assert prof == {"l0": None, "l1": 0.0, "l2": 0.0, "l3": 0.0, "l9": None}


def test_stand_ins_of_any_length_are_missing(spark):
    df = loads(spark, [("a", "s", "-" * n, "x") for n in (1, 200, 300, 5000)])
    assert P.profile(df, "load_id", ["transcription"]).first()["n_missing"] == 4
