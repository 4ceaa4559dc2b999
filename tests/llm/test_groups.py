import random

from pyspark.sql import functions as F

from nyuzi.llm import groups as G


def rows_of(spark, data):
    return spark.createDataFrame([(i, s, None if k is None else k.encode(), n) for i, (s, k, n) in enumerate(data)], "row_id long, speaker string, sentence binary, n_words int")


def brute(data, least=5):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for s, k, n in data:
        if s is not None and k is not None and n >= least:
            by.setdefault(k, set()).add(s)
    for speakers in by.values():
        first = min(speakers)
        for s in speakers:
            a, b = sorted((find(first), find(s)))
            parent[b] = a
    return {s: find(s) for s in parent}


def data_of(rng, n, speakers=40, sentences=60, tie=0.4):
    return [(rng.choice([None, *(f"s{i:02}" for i in range(speakers))]), f"t{rng.randrange(sentences)}" if rng.random() < tie else f"own{i}-{rng.random()}", rng.choice([2, 5, 9])) for i in range(n)]


def test_ties_against_brute_force(spark):
    for seed in range(3):
        data = data_of(random.Random(seed), 120, sentences=25)
        want = brute(data)
        big = {r for r in want.values() if sum(v == r for v in want.values()) > 1}
        got = {r["speaker_id"]: r["group_id"] for r in G.tied_speakers(G.update_components(rows_of(spark, data))).collect()}
        assert got == {s: r for s, r in want.items() if r in big}


def test_hot_speaker_and_sentence(spark):
    data = [("hot", f"x{i}", 6) for i in range(300)] + [(f"s{i}", "shared", 6) for i in range(300)] + [("hot", "shared", 6)]
    got = G.tied_speakers(G.update_components(rows_of(spark, data))).collect()
    assert len(got) == 301 and {r["group_id"] for r in got} == {"hot"}


def test_splits_are_disjoint_and_near_target(spark):
    data = data_of(random.Random(9), 3000, speakers=400, sentences=400, tie=0.05)
    rows = rows_of(spark, data)
    placed, table = G.assign_splits(rows)
    side = {r["row_id"]: r["split"] for r in placed.collect()}
    assert len(side) == len(data)
    seen = {}
    for i, (s, k, n) in enumerate(data):
        for node in ((("s", s),) if s else ()) + ((("t", k),) if n >= 5 else ()):
            assert seen.setdefault(node, side[i]) == side[i]
    share = [sum(v == s for v in side.values()) / len(side) for s, _ in G.SPLITS]
    assert abs(share[0] - 0.8) < 0.05 and abs(share[1] - 0.1) < 0.05 and abs(share[2] - 0.1) < 0.05


def test_later_deliveries_keep_splits_and_quarantine_conflicts(spark):
    first = [(f"s{i:03}", f"own{i}", 6) for i in range(200)]
    placed, table = G.assign_splits(rows_of(spark, first))
    table = table.cache()
    was = {r["node"][2:]: r["split"] for r in table.collect() if r["node"].startswith("s:")}
    train = next(s for s in sorted(was) if was[s] == "train")
    test = next(s for s in sorted(was) if was[s] == "test")
    later = [(f"s{i:03}", f"own{i}", 6) for i in range(100)] + [("new1", "n1", 6), (train, "bridge", 6), (test, "bridge", 6), ("new2", "own0", 6)]
    placed, table2 = G.assign_splits(rows_of(spark, later), table)
    side = {r["row_id"]: r["split"] for r in placed.collect()}
    for i, (s, _, _) in enumerate(later):
        if s in (train, test):
            assert side[i] == "quarantine"
        elif s in was:
            assert side[i] == was[s]
    assert side[103] == side[0]
    now = {r["node"][2:]: r["split"] for r in table2.collect()}
    assert set(was) <= set(now) and now["s150"] == was["s150"]


def test_a_later_delivery_alone_is_tied_through_persisted_sentences(spark):
    first = [(f"s{i:03}", f"own{i}", 6) for i in range(100)] + [("s000", "hello", 2)]
    _, table = G.assign_splits(rows_of(spark, first))
    table = table.cache()
    was = {r["node"]: r["split"] for r in table.collect()}
    a = next(i for i in range(100) if was[f"s:s{i:03}"] == "train")
    b = next(i for i in range(100) if was[f"s:s{i:03}"] == "test")
    c = next(i for i in range(a + 1, 100) if was[f"s:s{i:03}"] == "train")
    later = [("new", f"own{a}", 6), (None, f"own{a}", 6), ("bad", f"own{b}", 6), ("bad", f"own{c}", 6), ("free", "hello", 2)]
    placed, table2 = G.assign_splits(rows_of(spark, later), table)
    got = {r["row_id"]: (r["group"], r["split"]) for r in placed.collect()}
    assert got[0] == got[1] == (min("s:new", f"s:s{a:03}"), "train")
    assert got[2][1] == got[3][1] == "quarantine" and got[4][0] == "s:free"
    now = {r["node"]: r["split"] for r in table2.collect()}
    assert now[f"s:s{b:03}"] == now[f"s:s{c:03}"] == now["s:bad"] == "quarantine" and now["s:new"] == "train"
    assert all(now[n] == was[n] for n in was if n not in (f"s:s{b:03}", f"s:s{c:03}") and not n.startswith("t:"))
    assert len(table2.collect()) == len(now)


def test_a_sentence_that_gets_a_speaker_later(spark):
    unsaid = [(None, f"{i:032d}", 6) for i in range(60)]
    data = lambda rows: spark.createDataFrame([(i, s, bytes.fromhex(k), n) for i, (s, k, n) in enumerate(rows)], "row_id long, speaker string, sentence binary, n_words int")
    placed, table = G.assign_splits(data(unsaid))
    table = table.cache()
    was = {r["row_id"]: r["split"] for r in placed.collect()}
    a, b = next(i for i in was if was[i] == "train"), next(i for i in was if was[i] != "train")
    later = unsaid + [("one", unsaid[a][1], 6), ("two", unsaid[a][1], 6), ("both", unsaid[b][1], 6), ("both", unsaid[a][1], 6)]
    now = {r["row_id"]: r["split"] for r in G.assign_splits(data(later), table)[0].collect()}
    assert now[60] == now[61] == now[62] == now[63] == now[a] == now[b] == "quarantine"
    assert all(now[i] == was[i] for i in was if i not in (a, b))


def test_speakers_and_sentences_as_compared(spark):
    records = spark.createDataFrame([(1, 10, "Moja mbili, tatu nne [um] tano!"), (2, 20, "moja  mbili tatu nne tano"), (3, 30, None), (4, None, "x"), (5, 10, "")], "row_id long, clip_id long, text string")
    utterances = spark.createDataFrame([(10, " KIK-1 "), (20, "kik-2"), (10, "kik-1"), (30, " "), (None, "z")], "clip_id long, speaker_id string")
    rows = G.utterance_speakers(records, utterances).collect()
    assert len(rows) == 5
    assert sorted((r["row_id"], r["speaker"], r["n_words"]) for r in rows) == [(1, "kik-1", 5), (2, "kik-2", 5), (3, None, 0), (4, None, 1), (5, "kik-1", 0)]
    assert G.clip_ties(records, utterances).count() == 0
    got = G.tied_speakers(G.update_components(G.utterance_speakers(records, utterances))).select(F.concat_ws("/", "speaker_id", "group_id")).collect()
    assert sorted(r[0] for r in got) == ["kik-1/kik-1", "kik-2/kik-1"]


def test_all_speakers_of_a_clip_are_tied(spark):
    records = spark.createDataFrame([(1, 10, "moja mbili tatu nne tano"), (2, 20, "moja mbili tatu nne tano"), (3, 30, "sita")], "row_id long, clip_id long, text string")
    utterances = spark.createDataFrame([(10, "b"), (10, "C "), (20, "d"), (30, "e"), (40, "f"), (40, "g")], "clip_id long, speaker_id string")
    rows, ties = G.utterance_speakers(records, utterances), G.clip_ties(records, utterances)
    assert rows.count() == 3 and [tuple(r) for r in ties.collect()] == [("c", "b")]
    got = sorted(tuple(r) for r in G.tied_speakers(G.update_components(rows, ties=ties)).collect())
    assert got == [("b", "b"), ("c", "b"), ("d", "b")]


def test_deliveries_leave_the_same_ties_as_all_rows_at_once(spark, tmp_path):
    data = data_of(random.Random(11), 150, sentences=30)
    rows = rows_of(spark, data)
    parts = [rows.where("row_id < 50"), rows.where("row_id >= 50 AND row_id < 90"), rows.where("row_id >= 90")]
    got = {tuple(r) for r in G.tied_speakers(G.deliver_components(parts, str(tmp_path / "t"))).collect()}
    assert got == {tuple(r) for r in G.tied_speakers(G.update_components(rows)).collect()} and len(got) > 5
    assert (tmp_path / "t" / "v2").exists()


def test_deliveries_keep_what_they_placed(spark, tmp_path):
    data = data_of(random.Random(5), 1500, speakers=300, sentences=300, tie=0.05)
    rows = rows_of(spark, data)
    parts = [rows.where("row_id < 800"), rows.where("row_id >= 800")]
    placed, table = G.deliver(parts, str(tmp_path / "d"))
    side = {r["row_id"]: r["split"] for r in placed.collect()}
    was = {r["node"]: r["split"] for r in spark.read.parquet(str(tmp_path / "d" / "v0")).collect()}
    now = {r["node"]: r["split"] for r in table.collect()}
    assert set(side) == set(range(1500)) and set(was) <= set(now) and all(now[n] in (was[n], "quarantine") for n in was)
    seen = {}
    for i, (s, k, n) in enumerate(data):
        for node in ((("s", s),) if s else ()) + ((("t", k),) if n >= 5 else ()):
            assert seen.setdefault(node, side[i]) == side[i]
    assert {"train", "validation", "test"} <= set(side.values())


def test_short_sentences_lie_on_one_side(spark):
    rng = random.Random(3)
    data = [(f"s{i % 80:02}", f"own{i}", 6) for i in range(400)] + [(rng.choice([None, *(f"s{i:02}" for i in range(80))]), rng.choice(["yes", "no", "so"]), 1) for _ in range(90)]
    rows = rows_of(spark, data)
    placed, _ = G.assign_splits(rows)
    placed = placed.cache()
    was = {r["row_id"]: r["split"] for r in placed.collect()}
    out, sides = G.one_side(rows, placed)
    side, sides = {r["row_id"]: r["split"] for r in out.collect()}, {bytes(r["sentence"]).decode(): r["split"] for r in sides.collect()}
    assert set(side) == set(was) and set(sides) == {"yes", "no", "so"}
    seen = {}
    for i, (s, k, _) in enumerate(data):
        if side[i] != "quarantine":
            for node in (("s", s), ("t", k)):
                assert node == ("s", None) or seen.setdefault(node, side[i]) == side[i]
        assert side[i] == was[i] or (k in sides and was[i] != sides[k] and side[i] == (sides[k] if s is None else "quarantine"))
    assert "quarantine" in side.values() and "quarantine" not in was.values()
    kept = spark.createDataFrame([(b"yes", "test")], "sentence binary, split string")
    later = {r["row_id"]: r["split"] for r in G.one_side(rows, placed, kept)[0].collect()}
    assert {later[i] for i, (s, k, _) in enumerate(data) if k == "yes"} <= {"test", "quarantine"}
