"""Readers and writers of files that no query touches."""

import json

import pytest
from pyspark.sql import functions as F

from talkgraph.sources import readers, writers


def test_audio_and_inputs(spark, tmp_path):
    for s, names in (("a", ["x.wav", "x.m4a"]), ("b", ["y.mp3", "y.wav"]), ("c", ["notes.txt"])):
        (tmp_path / s).mkdir()
        for n in names:
            (tmp_path / s / n).write_bytes(b"1")
    got = readers.audio_files(spark, str(tmp_path))
    assert {r["file"].rsplit("/", 1)[1] for r in got.collect()} == {"x.m4a", "y.mp3"}
    every = spark.createDataFrame([(r["session_path"],) for r in got.collect()] + [("file:/none",)], "path string")
    assert readers.with_audio(every, got).count() == 2 and every.count() == 3
    t = {"u": spark.createDataFrame([("s1",), ("s2",)], "sample_id string"), "v": spark.createDataFrame([("s1",)], "sample_id string")}
    assert [r[0] for r in readers.inputs({"u": t["v"], "v": t["v"]}, ["u", "v"]).collect()] == ["s1"]
    with pytest.raises(Exception, match="s2 lacks v"):
        readers.inputs(t, ["u", "v"]).collect()


def test_objects_links_and_questions(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1,\n "b": "x"}')
    assert tuple(readers.json_objects(spark, f"{tmp_path}/o.json", "a int, b string").first()) == (1, "x")
    for s, n in (("s1", [("n1", "old"), ("n2", "own"), ("n1", "new")]), ("s2", [("n2", "late"), (" ", "no")])):
        (tmp_path / "run" / s).mkdir(parents=True)
        (tmp_path / "run" / s / "evidence_links.json").write_text(json.dumps({"sample_id": s, "node_evidence": [{"node_id": i, "content": c} for i, c in n]}))
    assert {(r["node_id"], r["content"]) for r in readers.evidence_links(spark, f"{tmp_path}/run", "content string").collect()} == {("n1", "new"), ("n2", "late")}
    (tmp_path / "q.jsonl").write_text('{"q": "one"}\n\nbroken\n{"q": "two"}\n{"q": "three"}\n')
    read = lambda n: [r["q"] for r in readers.questions(spark, f"{tmp_path}/q.jsonl", "q string", n).collect()]
    assert read(0) == ["one", "two", "three"] and read(2) == ["one", "two"]


def test_tables_of_splits_scores_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c")], "sample_id string, x string")
    writers.split_tables(rows, spark.createDataFrame([("s1", "train"), ("s2", "dev")], "sample_id string, split string"), f"{tmp_path}/split")
    assert {(r["sample_id"], r["split"]) for r in spark.read.parquet(f"{tmp_path}/split").collect()} == {("s1", "train"), ("s2", "dev")}
    writers.scores(spark.createDataFrame([("h", "r", "t", 0.12345678, "extra")], "head_id string, relation string, tail_id string, score double, z string"), f"{tmp_path}/scores")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/scores").collect()] == [("h", "r", "t", 0.123457)]
    writers.manifest(rows, rows.limit(1), f"{tmp_path}/m")
    assert (tmp_path / "m" / "failures").exists()
    writers.manifest(rows, rows.where("false"), f"{tmp_path}/m")
    assert not (tmp_path / "m" / "failures").exists() and [r["sample_id"] for r in spark.read.json(f"{tmp_path}/m/manifest").collect()] == ["s1", "s2", "s3"]
    writers.supervision(spark.createDataFrame([("train", "s", f"k{i}") for i in (3, 1, 2)], "split string, sample_id string, sample_key string"), f"{tmp_path}/sup")
    assert [r["sample_key"] for r in spark.read.parquet(f"{tmp_path}/sup").collect()] == ["k1", "k2", "k3"]
    writers.predictions(spark.createDataFrame([(1, "dev", 0.5)], "seed int, split string, s double"), f"{tmp_path}/pred")
    assert (tmp_path / "pred" / "seed=1" / "split=dev").exists()
    writers.reranked(spark.createDataFrame([("dev", 1)], "split string, id int"), spark.createDataFrame([(1,)], "n int"), f"{tmp_path}/re")
    assert spark.read.parquet(f"{tmp_path}/re/triples").count() == spark.read.json(f"{tmp_path}/re/report").count() == 1
    writers.dead_letters(spark.createDataFrame([("x", "why")], "t string, reason string"), f"{tmp_path}/dead")
    assert spark.read.json(f"{tmp_path}/dead").first()["reason"] == "why"


def test_pages_counted_and_drawn(spark, tmp_path):
    files = spark.createDataFrame([("a", b"/Type /Page /Type/Pages /Type /Page\n"), ("b", b"bad")], "id string, content binary")
    assert {r["id"]: r["n"] for r in files.select("id", readers.page_estimate(F.col("content")).alias("n")).collect()} == {"a": 2, "b": 0}
    got = readers.rendered_pages(files, "id", "content", f"{tmp_path}/out", lambda b: [b"p1", b"p2"] if b != b"bad" else 1 / 0).collect()
    assert {(r["id"], r["page"]) for r in got} == {("a", 1), ("a", 2)} and (tmp_path / "out" / "a" / "page_002.png").read_bytes() == b"p2"
