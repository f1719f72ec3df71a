"""Evidence operators on small rows."""

from pyspark.sql import functions as F

from talkgraph.operators import evidence as E

PROV = "array<struct<source_type:string,slide_id:string,region_id:string,bbox:array<int>,chunk_id:string,page:int>>"


def test_related_nodes(spark):
    rows = [("s", "c", "Claim", "dense encoder wins", 0.5)] + [("s", f"m{i}", "Method", t, 0.0) for i, t in enumerate(["dense encoder", "dense thing", "other words"])] + [("z", "m9", "Method", "dense encoder wins", 1.0), ("s", "l", "Limitation", None, None)]
    got = E.related_nodes(spark.createDataFrame(rows, "sample_id string, node_id string, type string, content string, confidence double"))
    assert {(r["node_id"], r["score"], r["rk"]) for r in got.collect()} == {("m0", 1.0, 1), ("m1", 0.5, 2), ("l", 0.0, 1)}


def test_slide_repairs(spark):
    t = spark.createDataFrame([(1, "aligned_to_slide", "Utterance", "u1", "x", []), (2, "referenced_by", "VisualRegion", "r7", "y", []), (3, "aligned_to_slide", "Claim", "c1", "x", []), (4, "compares", "Claim", "u1", "x", []), (5, "aligned_to_slide", "Claim", "nobody", None, None)], f"triple_id int, relation string, head_type string, head_id string, tail_id string, provenance {PROV}").withColumn("tail_type", F.lit("Slide")).union(spark.createDataFrame([(6, "aligned_to_slide", "ProsodyEvent", "e1", "x", [], "Slide")], f"triple_id int, relation string, head_type string, head_id string, tail_id string, provenance {PROV}, tail_type string"))
    links = spark.createDataFrame([("c1", [("u2",), ("u1",)], []), ("c2", [("u1",)], [("e1",)])], "node_id string, utterances array<struct<utterance_id:string>>, prosody_events array<struct<event_id:string>>")
    al = spark.createDataFrame([("u1", "s1", "r1", 1), ("u2", "s2", None, None)], "utterance_id string, slide_id string, region_id string, rk int")
    reg = spark.createDataFrame([("r1", "s1"), ("r7", "s3"), ("r9", "s2"), (None, "s2")], "region_id string, slide_id string")
    got = {r["triple_id"]: (r["slide_id"], r["region_id"], r["reason"]) for r in E.slide_repairs(t, links, al, reg).collect()}
    assert got == {1: ("s1", "r1", "utterance_alignment"), 2: ("s3", "r7", "head_visual_region_anchor"), 3: ("s2", "r9", "slide_default_region"), 6: ("s1", "r1", "utterance_alignment")}
    many = spark.createDataFrame([("c1", [(f"u{i:02d}",) for i in range(30)], None)], links.schema)
    assert [r["utterance_id"] for r in E.candidate_utterances(t.where("triple_id = 3"), many).orderBy("pos").collect()] == [f"u{i:02d}" for i in range(12)]


def test_distinct_summaries(spark):
    said = "a chart of four words"
    rows = [("s", "d", "i", "r1", said), ("s", "d", "i", "r2", said), ("s", "d", "j", "r3", said), ("s", "d", "i", "r4", "Blank region"), ("s", "d", "i", "r5", None), ("z", "d", "i", "r6", said)]
    got = {r["region_id"]: r["visual_summary"] for r in E.distinct_summaries(spark.createDataFrame(rows, "sample_id string, source_subdir string, source_image string, region_id string, visual_summary string")).collect()}
    assert got == {"r1": said, "r2": "", "r3": said, "r5": "", "r6": said}


def test_grid_and_edge_text(spark):
    g = E.grid_regions(spark.createDataFrame([("s", 101, 51)], "slide_id string, image_width int, image_height int")).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in g] == [(0, 0, 101, 51), (0, 0, 50, 25), (50, 0, 101, 25), (0, 25, 50, 51), (50, 25, 101, 51)]
    assert spark.range(1).select(E.edge_text(F.lit("measured_by"), F.lit(" A "), F.lit("B"))).first()[0] == "A is measured by B"


def test_links_of_nothing(spark):
    n = spark.createDataFrame([("s", "n1", "no match"), ("s", "n2", None)], "sample_id string, node_id string, content string")
    u = spark.createDataFrame([], "sample_id string, utterance_id string, text string")
    al = spark.createDataFrame([], "utterance_id string, slide_id string, region_id string, rk int")
    c = spark.createDataFrame([("s", "c1", "a match"), ("z", "c2", "no match")], "sample_id string, chunk_id string, text string")
    got = {r["node_id"]: (r["utterances"], r["chunks"]) for r in E.linked_nodes(n, u, al, c).collect()}
    assert got == {"n1": ([], ["c1"]), "n2": ([], [])}
