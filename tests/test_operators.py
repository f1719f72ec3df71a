"""Boundary cases of the operators on small rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from talkgraph.functions import provenance as P
from talkgraph.functions import text as X
from talkgraph.operators import audio as A
from talkgraph.operators import learning as M
from talkgraph.operators import orphans as O
from talkgraph.operators import retrieval as R
from talkgraph.operators import timeline as L
from talkgraph.operators import triples as T

SLIDES = "sample_id string, slide_id string, start_time double, end_time double"
PROV = (
    "struct<source_type:string,start_time:double,end_time:double,slide_id:string,region_id:string,bbox:array<int>,chunk_id:string,page:int,chunk_text_preview:string,"
    "chart_type:string,is_repaired:boolean,repair_method:string,repaired_granularity:string,similarity_score:double>"
)


def item(**kw):
    keys = "source_type start_time end_time slide_id region_id bbox chunk_id page chunk_text_preview chart_type is_repaired repair_method repaired_granularity similarity_score".split()
    return tuple(kw.get(k) for k in keys)


def at(spark, slides, t):
    p = spark.createDataFrame([("x", "u", t)], "sample_id string, utterance_id string, t double")
    return L.slide_at(p, spark.createDataFrame([("x", *s) for s in slides], SLIDES), "utterance_id", "t").first()["slide_id"]


def test_slide_alignment(spark):
    three = [("0", 0.0, 10.0), ("1", 10.0, 20.0), ("2", 20.0, None)]
    assert at(spark, three, 10.0) == "1"
    assert at(spark, three, 500.0) == "2"
    assert at(spark, [("0", 5.0, 10.0), ("1", 10.0, 20.0)], 25.0) == "1"
    assert at(spark, [("0", 5.0, 10.0)], 1.0) is None
    assert at(spark, [("0", None, 10.0)], 1.0) is None


def test_event_link(spark):
    ev = "sample_id string, event_id string, s double, e double"
    ut = "sample_id string, utterance_id string, us double, ue double"
    us = spark.createDataFrame([("x", "a", 0.0, 10.0), ("x", "b", 10.0, 20.0)], ut)
    assert L.linked_events(spark.createDataFrame([("x", "e", 8.0, 12.0)], ev), us).first()[1:] == ("a", 8.0, 10.0)
    us = spark.createDataFrame([("x", "a", 0.0, 1.0), ("x", "b", 10.0, 11.0)], ut)
    assert L.linked_events(spark.createDataFrame([("x", "e", 4.0, 5.0)], ev), us).first()[1:] == ("a", 0.99, 1.0)
    assert L.linked_events(spark.createDataFrame([], ev), us).count() == 0


def test_range_average(spark):
    spans = spark.createDataFrame([("x", "1", 0.0, 5.0), ("x", "2", 6.0, 9.0)], "sample_id string, span_id string, s double, e double")
    v = spark.createDataFrame([("x", 0.0, -20.0), ("x", 5.0, -30.0), ("x", 10.0, -40.0)], "sample_id string, t double, v double")
    assert {r["span_id"]: r["mean"] for r in L.range_average(spans, v).collect()} == {"1": -25.0, "2": -60.0}


def test_windows(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 9, 2])] + [("b", 0, 7.0), ("b", 1, 1.0), ("c", 0, 3.0)], "g string, i int, v double")
    got = {(r["g"], r["i"]): r["m"] for r in df.withColumn("m", L.median_filter(df, "g", ["i"], "v")).collect()}
    assert [got["a", i] for i in range(4)] == [5.0, 3.5, 3.5, 2.0] and got["b", 0] == 7.0
    z = {(r["g"], r["i"]): r["z"] for r in df.withColumn("z", L.z_score("g", "v")).collect()}
    assert (z["b", 0], z["b", 1], z["c", 0]) == (1.0, -1.0, 0.0)


def test_speech_segments(spark):
    s, d = "sample_id string, s double, e double", "sample_id string, duration double"
    got = L.speech_segments(spark.createDataFrame([("x", 2.0, 4.0), ("x", 3.0, 5.0), ("x", 9.9, 10.0)], s), spark.createDataFrame([("x", 10.0)], d))
    assert sorted(r[1:] for r in got.collect()) == [(0.0, 2.0), (5.0, 9.9)]
    assert L.speech_segments(spark.createDataFrame([("x", 0.1, 4.9)], s), spark.createDataFrame([("x", 5.0)], d)).count() == 0


def test_folds(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("x")).first()["x"]
    assert [len(p) for p in first(L.even_shards(F.array(*(F.lit(i) for i in range(5))), 4))] == [1, 1, 1, 2]
    assert [w["start"] for w in first(X.char_windows(F.lit("a" * 900)))] == [0, 400, 800]
    assert first(X.char_windows(F.lit(""))) == []
    assert first(X.content_key(F.lit("  Foo,  BAR! "))) == "foo-bar" and first(X.content_key(F.lit(""))) == "empty"
    assert first(X.metric_terms(F.lit("mAP and recall, F1; map"))) == ["F1", "MAP", "recall"]
    assert first(X.last_binary(F.lit("Score: 0 ... final 1"))) == "1" and first(X.last_binary(F.lit("n/a"))) is None
    assert first(X.packed(F.array(F.lit("aa"), F.lit("bb"), F.lit("c" * 10)), 5)) == ["aa bb", "c" * 10]
    assert first(X.semantic_windows(F.lit("One two. Three four. Five six."), 12, 3)) == ["One two.", "wo. Three four.", "ur. Five six."]
    assert [tuple(r) for r in first(A.chunk_ranges(F.lit(60.0), F.array(F.struct(F.lit(28.0).alias("s"), F.lit(29.0).alias("e")))))] == [(0.0, 28.0), (26.5, 60.0)]
    assert [tuple(r) for r in first(A.fixed_ranges(F.lit(0.0), F.lit(5.0), 2.0))] == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]
    assert first(A.pitch_slope(F.array(*(F.lit(float(i)) for i in range(6))))) == 4.0


def test_quality_and_tier(spark):
    rows = [
        (1, "supported_by", [item(source_type="slide_region", slide_id="s", region_id="r", bbox=[0, 0, 1, 1]), item(source_type="paper_chunk", chunk_id="c", page=1)], False),
        (2, "aligned_to_slide", [item(source_type="slide", slide_id="s")], False),
        (3, "aligned_to_slide", [item(slide_id="s", region_id="r", bbox=[0, 0, 1, 1]), item(source_type="audio", start_time=0.0, end_time=1.0), item(source_type="slide", slide_id="s", is_repaired=True, repaired_granularity="page_level")], False),
        (4, "supported_by", [], None),
    ]
    df = spark.createDataFrame(rows, f"triple_id int, relation string, provenance array<{PROV}>, is_repaired boolean")
    got = {r["triple_id"]: (r["provenance_score"], r["tier"]) for r in T.scored(df).collect()}
    assert got == {1: (1.0, "strong"), 2: (0.48, "medium"), 3: (1.0, "medium"), 4: (0.0, "weak")}
    q = df.select(F.explode("provenance").alias("p")).select(P.modality(F.col("p")).alias("m"), P.quality(F.col("p")).alias("q")).collect()
    assert ("paper", 1.0) in {tuple(x) for x in q}


def test_merge(spark):
    a, b = [item(source_type="audio", start_time=0.0, end_time=1.0)], [item(source_type="slide", slide_id="s")]
    df = spark.createDataFrame([(1, "h", "r", "t", 0.5, "stress", a, False), (2, "h", "r", "t", 0.91239, "pause", b, None), (3, "h", "r", "u", 0.123456, "pause", b, None)], f"triple_id int, head_id string, relation string, tail_id string, weight double, signal_source string, provenance array<{PROV}>, is_repaired boolean")
    got = {r["tail_id"]: r for r in T.merged(df).collect()}
    assert (got["t"]["weight"], got["t"]["signal_source"], [p["source_type"] for p in got["t"]["provenance"]]) == (0.9124, "hybrid", ["slide", "audio"])
    assert got["u"]["weight"] == 0.123456


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1)], "y int, s double")
    assert M.average_precision(df, "y", "s").first()[0] == round(0.25 + 1 / 3, 9)
    assert M.average_precision(df.where("y = 1"), "y", "s").first()[0] == 0.0
    w = spark.createDataFrame([("a", None), ("a", None), ("a", None), ("b", None)], "relation string, sample_weight double")
    assert sorted({r["weight"] for r in M.balanced_weights(w).collect()}) == [0.666667, 2.0]
    ids = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    assert {r["split"]: r["count"] for r in M.split_ids(ids, "id").groupBy("split").count().collect()} == {"train": 7, "dev": 1, "test": 2}
    p, r, f = M.retrieval_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d")))
    assert [round(x, 3) for x in spark.range(1).select(p, r, f).first()] == [0.333, 0.5, 0.4]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "h", "r", "a", "Result", 0.4), (1, "h", "r", "b", "Metric", 0.2)], "qid int, head_id string, relation string, tail_id string, tail_type string, score double")
    assert {round(r["score"], 9) for r in R.hyperedge_scores(df).collect()} == {0.66}
    one = df.withColumn("score", F.lit(0.5)).withColumn("mlp", F.lit(0.8))
    assert {round(r["score"], 6) for r in R.fused(one, "blend").collect()} == {0.68} and {round(r["score"], 6) for r in R.fused(one, "bonus").collect()} == {0.58}
    many = spark.createDataFrame([(1, "h", "r", str(i), float(i), 0.1) for i in range(8)], "qid int, head_id string, relation string, tail_id string, score double, mlp double")
    assert sorted(r["tail_id"] for r in R.fused(many, "filter").collect()) == ["3", "4", "5", "6", "7"]


# --- references to records that do not exist


def judge(parents, ref, t):
    rows = [p for p in parents if p[0] == "region" and p[1] == ref]
    if not rows:
        return "missing"
    if t is None:
        return None
    early = [p for p in rows if p[2] is None or p[2] <= t]
    if not early:
        return "late"
    return None if any(p[3] is None or p[3] > t for p in early) else "deleted"


REFS, ROWS = "source_table string, source_key string, ref_field string, kind string, ref_id string, at timestamp_ntz", "kind string, id string, born timestamp_ntz, gone timestamp_ntz"


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: datetime(2030, 1, 30) + timedelta(hours=rng.randrange(24 * 6))
    rows = [("region", f"r{rng.randrange(40)}", rng.choice([day(), day(), None]), rng.choice([None, None, day()])) for _ in range(60)]
    refs = [("t", str(i), "f", "region", rng.choice(["r1", f"r{rng.randrange(60)}"]), rng.choice([day(), day(), day(), None])) for i in range(400)]
    want = {(r[1], r[4], s) for r in refs if (s := judge(rows, r[4], r[5]))}
    got = O.orphans(spark.createDataFrame(refs + refs[:9], REFS), spark.createDataFrame(rows + rows[:5], ROWS)).collect()
    assert {(r["source_key"], r["ref_id"], r["status"]) for r in got} == want and len(got) == len(want)


def test_orphans_of_nothing(spark):
    empty_refs, empty_rows = spark.createDataFrame([], REFS), spark.createDataFrame([], ROWS)
    one = spark.createDataFrame([("t", "1", "f", "region", "", datetime(2030, 1, 1)), ("t", "2", "f", "region", "x" * 100_000, None)], REFS)
    assert O.orphans(empty_refs, empty_rows).count() == 0
    assert {(r["source_key"], r["status"], r["period"]) for r in O.orphans(one, empty_rows).collect()} == {("1", "missing", "2030-01"), ("2", "missing", None)}


def test_bitmaps_round_trip():
    import numpy as np

    for n in (0, 3, 5000):
        bits = np.zeros(1 << O.RANGE_BITS, np.uint8)
        bits[np.random.default_rng(1).choice(1 << O.RANGE_BITS, n, replace=False)] = 1
        assert (O.unpack(O.pack(np.packbits(bits, bitorder="little").tobytes())) == bits.astype(bool)).all()


def test_references_of_tables_with_clashing_columns(spark):
    t = datetime(2030, 1, 1)
    kg = spark.createDataFrame([(1, "a", "Slide", "b", "ProsodyEvent", t, "x", "y", "z"), (2, None, "Slide", "c", "Claim", None, "x", "y", "z"), (2, None, "Slide", "c", "Claim", None, "x", "y", "z")], "triple_id bigint, head_id string, head_type string, tail_id string, tail_type string, written_at timestamp_ntz, e string, at string, kind string")
    links = spark.createDataFrame([("n", t, [("r1",), (None,)], None, "q"), (None, t, [], None, "q"), ("m", t, None, t, "q")], "node_id string, written_at timestamp_ntz, visual_regions array<struct<region_id:string>>, deleted_at timestamp_ntz, ref_id string")
    refs = O.triple_refs(kg).union(O.region_refs(links))
    assert sorted((r["source_table"], r["ref_field"], r["kind"], r["ref_id"]) for r in refs.distinct().collect()) == [("evidence_links", "region_id", "region", "r1"), ("kg_triples", "head_id", "slide", "a"), ("kg_triples", "tail_id", "node", "c")]
    none = spark.createDataFrame([], "slide_id string, region_id string, chunk_id string, utterance_id string, written_at timestamp_ntz, deleted_at timestamp_ntz, born string")
    found = O.orphans(refs, O.parents(none, none, none, none, links))
    assert {(r["source_key"], r["ref_id"], r["status"]) for r in found.collect()} == {("1", "a", "missing"), ("2", "c", "missing"), ("n", "r1", "missing")}
    assert {(r["source_table"], r["n_refs"]) for r in O.orphan_report(found).collect()} == {("kg_triples", 1), ("evidence_links", 1)}


def test_a_hot_reference(spark):
    t = datetime(2030, 1, 2)
    refs = spark.createDataFrame([("t", str(i), "f", "region", "hot" if i % 3 == 0 else f"r{i}", t) for i in range(300)], REFS)
    assert O.orphans(refs, spark.createDataFrame([], ROWS)).count() == 300
    assert O.orphans(refs, spark.createDataFrame([("region", "hot", datetime(2030, 1, 1), None)], ROWS)).count() == 200


def test_parents_of_many_versions(spark):
    rng = random.Random(6)
    day = lambda: datetime(2030, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 40))
    rows = [("region", f"r{rng.randrange(3)}", day(), day()) for _ in range(120)] + [("region", "r2", None, datetime(2030, 1, 9)), ("region", "r9", day(), None)]
    refs = [("t", str(i), "f", "region", rng.choice(["r0", "r1", "r2", "r9", "none"]), rng.choice([day(), rows[i % 120][2], rows[i % 120][3], None])) for i in range(600)]
    want = {(r[1], r[4], s) for r in refs if (s := judge(rows, r[4], r[5]))}
    got = O.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(rows, ROWS)).collect()
    assert {(r["source_key"], r["ref_id"], r["status"]) for r in got} == want and len(got) == len(want) and {s for _, _, s in want} == {"missing", "late", "deleted"}


def test_a_key_range_without_orphans(spark):
    sound = spark.createDataFrame([("t", "1", "f", "region", "a", datetime(2030, 1, 2))], REFS)
    assert O.orphans(sound, spark.createDataFrame([("region", "a", datetime(2030, 1, 1), None)], ROWS)).count() == 0


def test_orphans_gather_nothing_per_key(spark, monkeypatch):
    monkeypatch.setattr(O, "written", lambda df, *_, **__: df)  # for the whole plan
    plan = O.orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "ObjectHashAggregate" not in plan and "collect_" not in plan
