"""Readers, writers, streaming jobs and providers on small files."""

import json

from pyspark.sql import functions as F

from talkgraph.operators import providers
from talkgraph.sources import readers as R
from talkgraph.sources import writers as W
from talkgraph.streaming import jobs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_sessions(spark, tmp_path):
    put(tmp_path / "conf/12_talk/metadata.json", json.dumps({"title": "T", "slides_data": {"slides": [{"time": 1.0}]}}))
    put(tmp_path / "conf/13_talk/metadata.json", json.dumps({"session_id": "x9"}))
    put(tmp_path / "conf/14_talk/metadata.json", "not json")
    assert {r["sample_id"] for r in R.sessions(spark, str(tmp_path)).collect()} == {"conf/12", "conf/x9"}


def test_json_lines(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"a": 1}\n\n[1]\nbroken {\n{"a": 2, "b": 3}\n{"a": \n')
    assert sorted(r["a"] for r in R.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    assert R.line_counts(spark, str(tmp_path / "a.jsonl")).first()["n"] == 5


def test_triples_and_fallback(spark, tmp_path):
    whole = {"sample_id": "c/s", "head": {"id": "h", "content": "H"}, "relation": "r", "tail": {"id": "t", "content": "T"}}
    put(tmp_path / "c/s/kg_triples_trainable.jsonl", json.dumps(whole) + "\n" + json.dumps({**whole, "head": {"id": "", "content": "H"}}))
    got = R.triples(spark, str(tmp_path)).collect()
    assert [(r["head_type"], r["weight"], r["tier"], r["provenance"]) for r in got] == [("Claim", 1.0, "weak", [])]


def test_maps(spark, tmp_path):
    put(tmp_path / "s.json", json.dumps({"a|r|b": 0.5, "a|b": 0.1}))
    assert [tuple(r) for r in R.edge_scores(spark, str(tmp_path / "s.json")).collect()] == [("a", "r", "b", 0.5)]
    put(tmp_path / "v.json", json.dumps({"n": [1.0, 2.0]}))
    assert R.vector_map(spark, str(tmp_path / "v.json")).first()["v"] == [1.0, 2.0]


def test_image_and_pages(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (360).to_bytes(4, "big")
    df = spark.createDataFrame([(png,), (b"jpg",)], "c binary")
    assert [tuple(r) for r in df.select(*R.png_size(F.col("c"))).collect()] == [(640, 360), (1000, 1000)]
    pdf = spark.createDataFrame([(b"/Type /Page\n/Type /Pages /Type/Page ",)], "c binary")
    assert pdf.select(R.page_estimate(F.col("c"))).first()[0] == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("c/s1", "strong", 1), ("c/s2", "weak", 2)], "sample_id string, tier string, x int")
    W.session_tables({"t": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").where("session = 's2'").first()["x"] == 2
    W.trainable(df, f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").count() == 1
    W.json_lines(df, f"{tmp_path}/log")
    W.json_lines(df, f"{tmp_path}/log", append=True)
    assert spark.read.json(f"{tmp_path}/log").count() == 4


def test_streams(spark, tmp_path):
    put(tmp_path / "in/1.json", '{"k": "a", "t": "2030-01-01 00:00:00"}\n{"k": "a", "t": "2030-01-01 00:00:01"}')
    schema = "k string, t timestamp"
    for n in (1, 2):
        jobs.resumable(spark, f"{tmp_path}/in", schema, lambda d: jobs.without_repeats(d, "t", ["k"], "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        put(tmp_path / f"in/{n + 1}.json", '{"k": "b", "t": "2030-01-01 00:00:02"}')


def test_gap_windows(spark, tmp_path):
    put(tmp_path / "g/1.json", '{"k": "a", "t": "2030-01-01 00:00:00"}\n{"k": "a", "t": "2030-01-01 00:00:05"}\n{"k": "a", "t": "2030-01-01 01:00:00"}')
    rows = spark.readStream.schema("k string, t timestamp").json(f"{tmp_path}/g")
    jobs.append_log(jobs.gap_windows(rows, "t", "k", "10 seconds", "1 second"), f"{tmp_path}/w", f"{tmp_path}/wc").awaitTermination()
    assert [r["n"] for r in spark.read.json(f"{tmp_path}/w").collect()] == [2]


def test_providers(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    got = providers.embedded(df, "t").collect()
    assert len(got) == 3 and got[0]["t"] is None or sum(r["embedding"] is None for r in got) == 1

    def fails(texts):
        raise RuntimeError

    assert {r["x"] for r in providers.called(df, "t", "x", "string", fails).collect()} == {None}
