"""Evidence of nodes: alignment, assembly, related nodes, repairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import provenance as P
from talkgraph.functions import text as X
from talkgraph.operators import blocks as B
from talkgraph.operators import providers
from talkgraph.operators.timeline import slide_at

#: kind of related node -> how many a claim takes (fixed values)
RELATED = {"Method": 2, "Result": 3, "Metric": 3, "Limitation": 1}


def aligned(utterances: DataFrame, slides: DataFrame, regions: DataFrame, cap: int = 3) -> DataFrame:
    """(utterance_id, slide_id, region_id, rk): each utterance's slide by time and that slide's most telling regions."""
    u = utterances.where("start_time is not null").select("sample_id", "utterance_id", F.col("start_time").alias("t"))
    at = slide_at(u, slides, "utterance_id", "t")
    full = lambda c: F.when(P.text(F.col(c)) != "", 2).otherwise(0)
    score = full("ocr_text") + full("visual_summary") + F.when(~P.text(F.col("chart_type")).isin("", "none"), 2).otherwise(0) + F.when(F.coalesce(F.size("entities"), F.lit(0)) > 0, 1).otherwise(0)
    w = Window.partitionBy("slide_id").orderBy(F.desc("score"), "region_id")
    r = regions.where("slide_id is not null").groupBy("slide_id", "region_id").agg(F.max(score).alias("score")).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= cap)
    return at.join(r, "slide_id", "left").select("utterance_id", "slide_id", "region_id", "rk")


def top_by_words(nodes: DataFrame, texts: DataFrame, by: str, k: int) -> DataFrame:
    """(node_id, id, score, rk): for each node (sample_id, node_id, content) the k texts (sample_id, id, text) of its session
    that share most words with it, by jaccard or overlap; texts without a common word are none of them.

    An id stored with several wordings counts with its best one. Null contents have no words.
    """
    worded = lambda df, key, c: df.where(F.col(key).isNotNull()).select("sample_id", F.col(key).alias("key"), X.token_hashes(F.coalesce(c, F.lit(""))).alias("words")).distinct()
    left, right = worded(nodes, "node_id", "content"), worded(texts, "id", "text")
    # a wording is a row of its own; of a text with several wordings at most that many are among the best
    several = lambda df: df.groupBy("sample_id", "key").agg(F.count("*").alias("c")).groupBy("sample_id").agg(F.max("c").alias("c"))
    left = left.join(several(right), "sample_id").select("sample_id", "words", F.concat_ws("\u001f", "key", F.hash("words").cast("string")).alias("lid"), (F.col("c") * k).cast("int").alias("need"))
    right = right.select("sample_id", "words", F.concat_ws("\u001f", "key", F.hash("words").cast("string")).alias("rid"))
    measure = {"jaccard": B.jaccard, "overlap": B.overlap}[by]

    def score(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        s = B.half_up(measure(a["words"], b["words"]), 6)
        return np.where(s > 0, s, np.nan)

    own = lambda c: F.substring_index(c, "\u001f", 1)
    got = B.best(left, right, ["sample_id"], score).groupBy(own("lid").alias("node_id"), own("rid").alias("id")).agg(F.max("score").alias("score"))
    w = Window.partitionBy("node_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("node_id", "id", "score", "rk")


def related_nodes(nodes: DataFrame) -> DataFrame:
    """(claim_id, node_id, type, score, rk): for each claim the methods, results, metrics and limitations of its
    session that share most words with it, plus a tenth of their confidence. nodes: sample_id, node_id, type, content,
    confidence, one row per session, id and type. All pairs are scored, in blocks.
    """
    n = nodes.select("sample_id", "node_id", "type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), X.token_hashes(F.coalesce("content", F.lit(""))).alias("words"))
    most = F.create_map(*(F.lit(x) for kv in RELATED.items() for x in kv))
    kinds = F.explode(F.array(*(F.lit(k) for k in RELATED)))
    left = n.where("type = 'Claim'").select("sample_id", F.col("node_id").alias("claim"), kinds.alias("type"), "words").withColumn("need", most[F.col("type")]).withColumn("lid", F.concat_ws("\u001f", "claim", "type"))
    right = n.where(F.col("type").isin(*RELATED)).select("sample_id", "type", F.col("node_id").alias("rid"), "words", "confidence")
    got = B.best(left, right, ["sample_id", "type"], lambda a, b: B.half_up(B.overlap(a["words"], b["words"]) + 0.1 * b["confidence"].to_numpy(float)[None, :], 6))
    return got.select(F.substring_index("lid", "\u001f", 1).alias("claim_id"), F.col("rid").alias("node_id"), F.substring_index("lid", "\u001f", -1).alias("type"), "score", "rk")


def claim_evidence(related: DataFrame, links: DataFrame, cap: int = 12) -> DataFrame:
    """(claim_id, chunk_id, pos): paper chunks of a claim and of its related nodes, in order, each once, the first cap."""
    own = related.select("claim_id").distinct().select("claim_id", F.col("claim_id").alias("node_id"), F.lit(0).alias("o"))
    order = {k: i for i, k in enumerate(RELATED, 1)}
    o = F.lit(9)
    for k, i in order.items():
        o = F.when(F.col("type") == k, i).otherwise(o)
    sources = own.union(related.select("claim_id", "node_id", (o * 100 + F.col("rk")).alias("o")))
    chunks = links.where("node_id is not null").select("node_id", F.posexplode("paper_chunks.chunk_id").alias("p", "chunk_id")).where("chunk_id is not null")
    first = sources.join(chunks, "node_id").groupBy("claim_id", "chunk_id").agg(F.min(F.struct("o", "p")).alias("k"))
    w = Window.partitionBy("claim_id").orderBy("k", "chunk_id")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("claim_id", "chunk_id", "pos")


def repair_targets(triples: DataFrame) -> DataFrame:
    """Triples that should have slide evidence and have none."""
    wanted = (F.col("relation") == "aligned_to_slide") | ((F.col("relation") == "referenced_by") & (F.col("head_type") == "VisualRegion"))
    return triples.where(wanted & (F.coalesce(F.size(P.items(F.col("provenance"), "slide")), F.lit(0)) <= 0))


def candidate_utterances(triples: DataFrame, links: DataFrame, cap: int = 12) -> DataFrame:
    """(triple_id, utterance_id, pos): the utterances a triple may have been said in, each once, the first cap: its ends
    that are utterances, those of ends that are prosody events, then the ends' evidence."""
    end = lambda e: F.struct(F.col(f"{e}_id").alias("id"), F.col(f"{e}_type").alias("type"))
    ends = triples.select("triple_id", F.posexplode(F.array(end("head"), end("tail"))).alias("e", "n")).select("triple_id", "e", "n.id", "n.type").where("id is not null")
    said = links.where("size(utterances) > 0").select(F.explode("prosody_events.event_id").alias("id"), F.element_at("utterances", 1)["utterance_id"].alias("utterance_id")).where("id is not null").groupBy("id").agg(F.min("utterance_id").alias("utterance_id"))
    ev = links.where("node_id is not null").select(F.col("node_id").alias("id"), F.posexplode("utterances.utterance_id").alias("p", "utterance_id"))
    row = lambda df, stage, p: df.select("triple_id", "utterance_id", F.struct(F.lit(stage).alias("stage"), F.col("e").alias("e"), p.alias("p")).alias("o"))
    own = row(ends.where("type = 'Utterance'").withColumn("utterance_id", F.col("id")), 0, F.lit(0))
    every = own.union(row(ends.where("type = 'ProsodyEvent'").join(said, "id"), 1, F.lit(0))).union(row(ends.join(ev, "id"), 2, F.col("p")))
    first = every.where("trim(coalesce(utterance_id, '')) <> ''").groupBy("triple_id", "utterance_id").agg(F.min("o").alias("o"))
    w = Window.partitionBy("triple_id").orderBy("o", "utterance_id")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("triple_id", "utterance_id", "pos")


def slide_repairs(triples: DataFrame, links: DataFrame, alignment: DataFrame, regions: DataFrame) -> DataFrame:
    """(triple_id, slide_id, region_id, reason): slide evidence for triples that lack it.

    In order of preference: the region that the head is; then, for each candidate utterance in order (the ends
    themselves, then their evidence), its aligned region, or else its slide's first region. All candidates are
    made, and the one with the least priority is taken. Triples without a candidate are left out.
    """
    t = repair_targets(triples).where("triple_id is not null")
    r = regions.where("region_id is not null").groupBy("region_id").agg(F.min("slide_id").alias("slide_id"))
    head = t.where("relation = 'referenced_by'").join(r, F.col("head_id") == F.col("region_id")).select("triple_id", F.struct(F.lit(0).alias("stage"), F.lit(0).alias("pos"), F.lit(0).alias("how"), F.col("slide_id").alias("slide_id"), "region_id", F.lit("head_visual_region_anchor").alias("reason")).alias("c"))
    cand = candidate_utterances(t, links)
    first_region = regions.where("slide_id is not null").groupBy("slide_id").agg(F.min("region_id").alias("default_region"))
    al = alignment.where("slide_id is not null and (rk = 1 or rk is null)").select("utterance_id", "slide_id", "region_id").distinct().join(first_region, "slide_id", "left")
    heard = cand.join(al, "utterance_id").select(
        "triple_id",
        F.struct(
            F.lit(1).alias("stage"), F.col("pos").alias("pos"), F.when(F.col("region_id").isNotNull(), 0).when(F.col("default_region").isNotNull(), 1).otherwise(2).alias("how"), F.col("slide_id").alias("slide_id"),
            F.coalesce("region_id", "default_region").alias("region_id"), F.when(F.col("region_id").isNotNull(), "utterance_alignment").when(F.col("default_region").isNotNull(), "slide_default_region").otherwise("slide_page").alias("reason"),
        ).alias("c"),
    )
    return head.union(heard).groupBy("triple_id").agg(F.min("c").alias("c")).select("triple_id", "c.slide_id", "c.region_id", "c.reason")


def edge_text(relation: Column, head: Column, tail: Column) -> Column:
    """The wording of an edge that is searched for in the paper."""
    phrase = F.regexp_replace(relation, "_", " ")
    for r, p in O.PHRASES.items():
        phrase = F.when(relation == r, p).otherwise(phrase)
    return F.trim(F.concat(P.text(head), F.lit(" "), phrase, F.lit(" "), P.text(tail)))


def paper_targets(triples: DataFrame) -> DataFrame:
    """Triples that should have paper evidence and have none."""
    return triples.where((P.weight(F.col("relation"), "paper") > 0) & (F.coalesce(F.size(P.items(F.col("provenance"), "paper")), F.lit(0)) <= 0))


def paper_repairs(triples: DataFrame, edge_vectors: DataFrame, chunk_vectors: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(triple_id, chunk_id, similarity): the nearest chunk of the session for edges that should have paper evidence and have none, if near enough.

    edge_vectors: triple_id, qv; chunk_vectors: sample_id, chunk_id, v, both of unit length. Every chunk of the session is
    compared, in blocks; of equally near ones the last id is taken.
    """
    left = paper_targets(triples).select("triple_id", "sample_id").join(edge_vectors, "triple_id").where("qv is not null").select("sample_id", F.col("triple_id").alias("lid"), "qv", F.lit(1).alias("need"))
    right = chunk_vectors.where("chunk_id is not null and v is not null").select("sample_id", F.col("chunk_id").alias("rid"), "v")
    got = B.best(left, right, ["sample_id"], lambda a, b: B.half_up(B.products(a["qv"], b["v"]), 4), descending=True)
    return got.where(F.col("score") >= threshold).select(F.col("lid").alias("triple_id"), F.col("rid").alias("chunk_id"), F.col("score").alias("similarity"))


def near_chunks(triples: DataFrame, chunks: DataFrame, provider: providers.Provider = providers.hashed_embedding) -> DataFrame:
    """paper_repairs() of triples and chunks (sample_id, chunk_id, text) whose vectors a provider makes, offline by default."""
    kg = paper_targets(triples)
    q = providers.embedded(kg.select("triple_id", edge_text(F.col("relation"), F.col("head_content"), F.col("tail_content")).alias("t")), "t", provider).select("triple_id", F.col("embedding").alias("qv"))
    c = providers.embedded(chunks.where("text is not null").select("sample_id", "chunk_id", "text").distinct(), "text", provider).select("sample_id", "chunk_id", F.col("embedding").alias("v"))
    return paper_repairs(kg, q, c)


def distinct_summaries(regions: DataFrame, most: float = 0.9) -> DataFrame:
    """Regions with templated summaries dropped, and repeated summaries of an image blanked (the first stays).

    Each summary is compared with those kept before it on its image, a fold over the image's regions.
    """
    s = P.text(F.col("visual_summary"))
    r = regions.where(~s.rlike(O.UNINFORMATIVE)).select("sample_id", "source_subdir", "source_image", "region_id", s.alias("summary")).distinct()
    item = F.struct("region_id", "summary", X.tokens(F.col("summary")).alias("tk"))
    kind = "struct<region_id:string,summary:string,tk:array<string>>"
    zero = F.array().cast(f"array<struct<region_id:string,kept:boolean,x:{kind}>>")
    same = lambda k, x: k["kept"] & ((k["x"]["summary"] == x["summary"]) | ((F.size(k["x"]["tk"]) >= 4) & (F.size(x["tk"]) >= 4) & (X.jaccard(k["x"]["tk"], x["tk"]) >= most)))
    step = lambda a, x: F.concat(a, F.array(F.struct(x["region_id"].alias("region_id"), ((x["summary"] != "") & ~F.exists(a, lambda k: same(k, x))).alias("kept"), x.alias("x"))))
    folded = r.groupBy("sample_id", "source_subdir", "source_image").agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step).alias("a"))
    return folded.select(F.explode("a").alias("a")).select("a.region_id", F.when(F.col("a.kept"), F.col("a.x.summary")).otherwise("").alias("visual_summary"))


def grid_regions(images: DataFrame) -> DataFrame:
    """The whole image and its four quadrants: (slide_id, n, x0, y0, x1, y1)."""
    w, h = F.col("image_width"), F.col("image_height")
    hw, hh = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    z = F.lit(0)
    boxes = F.array(F.array(z, z, w, h), F.array(z, z, hw, hh), F.array(hw, z, w, hh), F.array(z, hh, hw, h), F.array(hw, hh, w, h))
    return images.select("slide_id", F.posexplode(boxes).alias("n", "b")).select("slide_id", "n", *(F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def linked_nodes(nodes: DataFrame, utterances: DataFrame, alignment: DataFrame, chunks: DataFrame, top_utterances: int = 3, top_chunks: int = 3, top_regions: int = 3) -> DataFrame:
    """Evidence of each node: (node_id, utterances, slides, regions, chunks), arrays of ids in order of preference.

    Utterances by overlap of words (above 0), the slides and regions those are aligned to, each once, and
    paper chunks by Jaccard of words. Nodes meet all texts of their
    session, in blocks; a node without any match has empty arrays. nodes: sample_id, node_id, content; utterances: sample_id, utterance_id, text; chunks: sample_id,
    chunk_id, text; alignment: as aligned() gives it.
    """
    n = nodes.where("node_id is not null")

    def met(texts: DataFrame, id_col: str, by: str, k: int) -> DataFrame:
        return top_by_words(n, texts.where("text is not null").select("sample_id", F.col(id_col).alias("id"), "text"), by, k).select("node_id", F.col("id").alias(id_col), "rk")

    def listed(df: DataFrame, id_col: str, out: str, k: int) -> DataFrame:
        first = df.where(F.col(id_col).isNotNull()).groupBy("node_id", id_col).agg(F.min("o").alias("o"))
        w = Window.partitionBy("node_id").orderBy("o", id_col)
        kept = first.withColumn("p", F.row_number().over(w)).where(F.col("p") <= k)
        return kept.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", id_col))), lambda x: x[id_col]).alias(out))

    u = met(utterances, "utterance_id", "overlap", top_utterances)
    seen = u.withColumnRenamed("rk", "o").join(alignment.select("utterance_id", "slide_id", "region_id", F.coalesce("rk", F.lit(0)).alias("r")), "utterance_id", "left").withColumn("o", F.col("o") * 100 + F.coalesce("r", F.lit(0)))
    c = met(chunks, "chunk_id", "jaccard", top_chunks).withColumnRenamed("rk", "o")
    out = n.select("node_id").distinct()
    for df, id_col, name, k in ((seen, "utterance_id", "utterances", top_utterances), (seen, "slide_id", "slides", top_utterances), (seen, "region_id", "regions", top_regions), (c, "chunk_id", "chunks", top_chunks)):
        out = out.join(listed(df, id_col, name, k), "node_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
