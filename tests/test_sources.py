import io
import json
import tarfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nyuzi.session import table
from nyuzi.sources import adapters, readers, sinks
from nyuzi.streaming import ingest


def archive(path, members):
    with tarfile.open(path, "w:xz") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_archive_and_manifest(spark, tmp_path):
    archive(tmp_path / "audio_1.tar.xz", {"x/a.wav": b"A", "x/b.wav": b"B", "y/a.wav": b"A2"})
    records = [{"audio_filepath": "clips/a.wav", "transcription": "one"}, {"audio_filepath": "clips/c.wav"}, {"transcription": "no path"}, {"audio_filepath": ""}]
    (tmp_path / "m.jsonl").write_text("\n\n".join(map(json.dumps, records)) + "\n")
    m = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    members = readers.archive_members(spark, str(tmp_path), "*.tar.xz")
    assert m.count() == 4 and members.count() == 3
    got = readers.with_members(m, members).collect()
    assert [(r["transcription"], r["member_path"], bytes(r["content"])) for r in got] == [("one", "x/a.wav", b"A")]
    assert {r["reason"]: r["n"] for r in readers.unmatched(m, members).collect()} == {"no path": 2, "no member": 1}


def test_listing(spark, tmp_path):
    for name, size in (("a/x.parquet", 3), ("a/y.txt", 5), ("b/z.parquet", 7)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * size)
    assert sorted(r["size"] for r in readers.listing(spark, str(tmp_path), ".parquet").collect()) == [3, 7]
    files = spark.createDataFrame([("a/x", 3), ("a/y", None), ("b/z", 7)], "path string, size long")
    assert [tuple(r) for r in readers.largest_directories(files).collect()] == [("b", 1, 7), ("a", 2, 3)]


def test_payload_of_binary_and_struct(spark):
    plain = spark.createDataFrame([(b"x",)], "audio_bytes binary")
    nested = spark.createDataFrame([((b"x", "p"), "u")], "audio struct<bytes:binary,path:string>, recorder_uuid string")
    for df, who in ((plain, ""), (nested, "u")):
        r = adapters.embedded(df, "kik").first()
        assert bytes(r["audio"]) == b"x" and r["speaker_id"] == who and r["text"] == "" and r["language"] == "kik"
    with pytest.raises(TypeError):
        adapters.payload(spark.createDataFrame([("t",)], "audio string"), "audio")


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("s1", 3, 0.5), ("s2", 4, None)], "src string, rows long, hours double")
    sinks.progress(df, str(tmp_path / "log"))
    sinks.progress(df, str(tmp_path / "log"))
    log = readers.progress(spark, str(tmp_path / "log"))
    assert log.count() == 4 and tuple(readers.progress_totals(log).first()) == (2, 1.0)
    sinks.table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))
    parts = [pq.ParquetFile(p).metadata for p in (tmp_path / "t").glob("*.parquet")]
    assert {m.row_group(0).column(0).compression for m in parts if m.num_row_groups} == {"ZSTD"}
    assigned = spark.createDataFrame([("kik", "b", 2, True), ("kik", "a", 3, True), ("kik", "c", 9, False)], "language string, speaker string, n long, is_dev boolean")
    sinks.split_descriptors(assigned, str(tmp_path / "d"))
    r = readers.json_document(spark, str(tmp_path / "d")).first()
    assert (r["total_rows"], r["dev_rows"], r["dev_speakers"]) == (14, 5, ["a", "b"])


def test_corpus_folders_are_pruned(spark, tmp_path):
    rows = [(i, "t", ["train", "dev"][i % 2], ["kik", "luo", "mas"][i % 3]) for i in range(12)]
    sinks.corpus(spark.createDataFrame(rows, "i int, text string, split string, language string"), str(tmp_path / "c"))
    back = readers.corpus(spark, str(tmp_path / "c"), ["kik"], "dev")
    assert sorted(r["i"] for r in back.collect()) == [3, 9] and "version" in back.columns
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()


def test_submission_resumes(spark, tmp_path):
    first = spark.createDataFrame([("1", "kik", "a, \"b\""), ("2", "kik", "")], "id string, language string, transcription string")
    more = first.unionByName(spark.createDataFrame([("3", "luo", None)], first.schema))
    path = str(tmp_path / "s")
    assert sinks.resume_submission(first, path, False) == 2
    assert sinks.resume_submission(more, path, True) == 1
    assert sorted(map(tuple, readers.submission(spark, path).collect())) == [("1", "kik", "a, \"b\""), ("2", "kik", "."), ("3", "luo", ".")]


def test_count_equals_the_footer(spark, sf):
    assert table(spark, sf, "lineitem").count() == pq.ParquetFile(f"{sf}/lineitem.parquet").metadata.num_rows


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    a.coalesce(1).write.parquet(source)
    ingest.ingest_new(spark, source, a.schema, sink, log, "id")
    spark.createDataFrame([(2, "again"), (3, "z")], a.schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.ingest_new(spark, source, a.schema, sink, log, "id", lambda s: s.withColumn("w", F.upper("v")))
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:01", "b")]
    spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream, "ts", "k", "1 minute", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_watch_copies_finished_steps_and_repeats_what_failed(spark, tmp_path):
    source, target = tmp_path / "run", tmp_path / "copy"
    for step in ("step_100", "step_20", "step_30.tmp"):
        (source / step).mkdir(parents=True)
        (source / step / "model.pt").write_bytes(step.encode())

    def short(a, b):
        return 1

    with pytest.raises(Exception, match="wrong size"):
        ingest.watch(spark, str(source), str(target), str(tmp_path / "log"), upload=short).awaitTermination()
    ingest.watch(spark, str(source), str(target), str(tmp_path / "log")).awaitTermination()
    assert sorted(p.name for p in target.iterdir()) == ["step_100", "step_20"]
    assert (target / "step_20" / "model.pt").read_bytes() == b"step_20"


def test_listings_compared(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, size long")
    steps = ingest.steps_in(df([("r/step_100/m", 1), ("r/step_9/m", 2), ("r/step_9.tmp/m", 3)]))
    assert [r["step"] for r in steps.collect()] == [9, 100]
    assert [r["path"] for r in ingest.stable(df([("a", 1), ("b", 2)]), df([("a", 1), ("b", 3), ("c", 1)])).collect()] == ["a"]
    local = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, size long")
    remote = spark.createDataFrame([("a", 1), ("b", 9)], "name string, size long")
    assert sorted(r["name"] for r in ingest.mismatched(local, remote).collect()) == ["b", "c"]


def test_states_card_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "w", True, [1.0]), (2, "w", True, [3.0])], "ckpt int, key string, is_float boolean, values array<float>")
    sinks.states(df, str(tmp_path / "s"))
    assert sorted((r["ckpt"], r["values"]) for r in readers.states(spark, str(tmp_path / "s")).collect()) == [(1, [1.0]), (2, [3.0])]
    sinks.card(str(tmp_path / "card.yaml"), "n", "f", "/data", "t")
    assert (tmp_path / "card.yaml").read_text().startswith("name: n\n")
    assert sinks.report(spark.createDataFrame([("a", 1.23456), ("b", None)], "k string, v double")) == ["k\tv", "a\t1.2346", "b\t-"]


def test_watching_goes_on_after_a_failure(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    (source / "step_5").mkdir(parents=True)
    (source / "step_5" / "a.bin").write_bytes(b"x" * 10)
    marker, said = tmp_path / "failed", []

    def once(a, b):
        if not marker.exists():
            marker.write_text("")
            raise OSError("no room")
        return ingest.copy_file(a, b)

    assert ingest.keep_watching(spark, str(source), str(target), str(tmp_path / "log"), pause=0.0, cycles=2, upload=once, say=said.append) == 1
    assert (target / "step_5" / "a.bin").read_bytes() == b"x" * 10 and len(said) == 1


def test_state_of_keys_is_given_up(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id long, ts string").select("id", F.to_timestamp("ts").alias("ts"))
    df.write.parquet(source)
    ingest.ingest_new(spark, source, df.schema, sink, log, "id", time="ts")
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_row_counts_read_footers_only(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "r"))
    n = readers.row_counts(spark, str(tmp_path / "r"))
    assert [r["n_rows"] for r in n.collect()] == [10] and "ReadSchema: struct<>" in n._jdf.queryExecution().executedPlan().toString()
