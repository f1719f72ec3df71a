"""Triples: validation, merging, scoring and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import provenance as P


def allowed_pairs(df: DataFrame) -> DataFrame:
    """The constraint table, 53 rows."""
    return df.sparkSession.createDataFrame(O.allowed(), "head_type string, relation string, tail_type string")


def relation_allowed(triples: DataFrame) -> DataFrame:
    """Triples whose (head type, relation, tail type) the ontology allows."""
    return triples.join(F.broadcast(allowed_pairs(triples)), ["head_type", "relation", "tail_type"], "left_semi")


def clean_weight(w: Column, default: float = 0.6) -> Column:
    """A weight within 0 and 1; null and NaN become the default."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(w.isNull() | F.isnan(w), F.lit(default)).otherwise(w)))


def valid(triples: DataFrame) -> DataFrame:
    """Triples with ids and contents, allowed types and some provenance; weight cleaned, signal source filled, exact repeats dropped."""
    whole = triples.where(" and ".join(f"trim(coalesce({c}, '')) <> ''" for c in ("head_id", "tail_id", "head_content", "tail_content")) + " and size(provenance) > 0")
    return (
        relation_allowed(whole)
        .withColumn("weight", clean_weight(F.col("weight")))
        .withColumn("signal_source", F.coalesce(F.nullif(F.trim("signal_source"), F.lit("")), F.lit("semantic")))
        .dropDuplicates(["sample_id", "head_id", "relation", "tail_id", "weight", "signal_source", "provenance"])
    )


def merged(triples: DataFrame, order: str = "triple_id") -> DataFrame:
    """One row per (head_id, relation, tail_id): of the row with the highest weight (first on a tie) the rest;
    weight rounded to 4 places if there were several rows, provenance of all rows without repeats, the
    keeper's first, and signal source hybrid if the rows differ in it.

    A key's rows are folded by partial aggregation; a hot key costs its distinct provenance, not its rows.
    """
    w = F.coalesce("weight", F.lit(0.0))
    agg = triples.groupBy("head_id", "relation", "tail_id").agg(
        F.count("*").alias("n_rows"),
        F.max(F.struct(w.alias("w"), (-F.col(order)).alias("o"), F.col("signal_source").alias("s"), F.col("provenance").alias("p"))).alias("k"),
        F.min_by("signal_source", order).alias("s0"),
        (F.min("signal_source") != F.max("signal_source")).alias("mixed"),
        F.collect_set("provenance").alias("all_p"),
        F.bool_or(F.coalesce("is_repaired", F.lit(False))).alias("is_repaired"),
    )
    items = F.array_distinct(F.concat(F.coalesce("k.p", F.element_at("all_p", 1)), F.flatten("all_p")))
    return agg.select(
        "head_id", "relation", "tail_id", "n_rows",
        F.when(F.col("n_rows") > 1, F.round("k.w", 4)).otherwise(F.col("k.w")).alias("weight"),
        F.when(F.col("mixed"), "hybrid").otherwise(F.col("k.s")).alias("signal_source"),
        items.alias("provenance"), "is_repaired",
    )


def scored(triples: DataFrame) -> DataFrame:
    """provenance without repeats, provenance_score (rounded to 4), tier and is_repaired worked out anew."""
    t = triples.withColumn("provenance", F.array_distinct("provenance"))
    raw = P.raw_score(F.col("relation"), F.col("provenance"))
    rep = P.repaired(F.col("provenance"), F.col("is_repaired"))
    return (
        t.withColumn("_raw", raw).withColumn("is_repaired", rep)
        .withColumn("tier", P.tier(F.col("_raw"), F.col("provenance"), F.col("is_repaired")))
        .withColumn("provenance_score", F.round("_raw", 4)).drop("_raw")
    )


def completeness(triples: DataFrame) -> DataFrame:
    """Per relation: edges, mean share of the expected modalities that are present, and edges with each modality."""
    has = {m: F.size(P.items(F.col("provenance"), m)) > 0 for m in P.MODALITIES}
    flags = triples.where("trim(relation) <> ''").select("relation", *(F.coalesce(h, F.lit(False)).alias(m) for m, h in has.items()))
    expected = sum(((P.weight(F.col("relation"), m) > 0).cast("int") for m in P.MODALITIES), F.lit(0))
    there = sum((((P.weight(F.col("relation"), m) > 0) & F.col(m)).cast("int") for m in P.MODALITIES), F.lit(0))
    cov = F.when(expected > 0, there / expected).otherwise(1.0)
    return flags.groupBy("relation").agg(
        F.count("*").alias("edges"), F.round(F.avg(cov), 4).alias("avg_expected_coverage"), *(F.count_if(F.col(m)).alias(f"with_{m}") for m in P.MODALITIES)
    )


def known_tier(t: Column) -> Column:
    low = F.lower(F.trim(t))
    return F.when(low.isin("strong", "medium", "weak"), low).otherwise("weak")


def coverage(triples: DataFrame) -> DataFrame:
    """Per session: logical edges, supported or measured edges, and whether they suffice (3 and 1)."""
    return triples.groupBy("sample_id").agg(
        F.count_if(F.col("relation").isin(*O.LOGICAL)).alias("logical_total"), F.count_if(F.col("relation").isin("supported_by", "measured_by")).alias("supported_or_measured")
    ).withColumn("passed", (F.col("logical_total") >= 3) & (F.col("supported_or_measured") >= 1))


def quality_report(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Per session: coverage, tiers, emphasis, visual semantics, missing provenance and status.

    The most emphasised tail is found from counts per tail, so no session's edges meet in one task.
    """
    base = triples.groupBy("sample_id").agg(
        F.count_if(F.col("relation").isin(*O.LOGICAL)).alias("logical_total"),
        F.count_if(F.col("relation").isin("supported_by", "measured_by")).alias("supported_or_measured"),
        *(F.count_if(known_tier(F.col("tier")) == t).alias(t) for t in ("strong", "medium", "weak")),
        F.count_if(F.coalesce(F.size("provenance"), F.lit(0)) <= 0).alias("missing_provenance"),
    )
    emph = (
        triples.where("relation = 'emphasizes'").groupBy("sample_id", F.coalesce("tail_id", F.lit("")).alias("tail")).agg(F.count("*").alias("n"))
        .groupBy("sample_id").agg(F.sum("n").alias("emph_total"), F.count("*").alias("emph_tails"), F.round(F.max("n") / F.sum("n"), 4).alias("dominant_ratio"))
    )
    seen = lambda r: (P.text(r["ocr_text"]) != "") | (P.text(r["visual_summary"]) != "")
    vis = links.groupBy("sample_id").agg(
        F.sum(F.coalesce(F.size("visual_regions"), F.lit(0))).alias("regions_total"), F.sum(F.coalesce(F.size(F.filter("visual_regions", seen)), F.lit(0))).alias("regions_seen")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = (F.col("logical_total") >= 3) & (F.col("supported_or_measured") >= 1) & ~((zero("regions_total") > 0) & (zero("regions_seen") == 0))
    return base.join(emph, "sample_id", "left").join(vis, "sample_id", "left").select(
        "sample_id", "logical_total", "supported_or_measured", "strong", "medium", "weak", "missing_provenance",
        zero("emph_total").alias("emph_total"), zero("emph_tails").alias("emph_tails"), F.coalesce("dominant_ratio", F.lit(0.0)).alias("dominant_ratio"),
        zero("regions_total").alias("regions_total"), F.round(zero("regions_seen") / F.greatest(F.lit(1), zero("regions_total")), 4).alias("visual_coverage"),
        F.when(ok, "ok").otherwise("failed_coverage").alias("quality_status"),
    )


def modality_summary(df: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and statistics of each row's provenance per modality: what a scorer of edges sees of it."""
    prov = F.col("provenance")
    audio, slide, paper = (P.items(prov, m) for m in P.MODALITIES)
    span = F.aggregate(audio, F.lit(0.0), lambda a, p: a + F.when(p["end_time"] > p["start_time"], p["end_time"] - p["start_time"]).otherwise(0.0))
    chart = F.exists(slide, lambda p: ~P.text(p["chart_type"]).isin("", "none"))
    return df.select(
        *keep,
        F.size(audio).alias("audio_count"), P.best(prov, "audio").alias("audio_quality_max"), F.round(span, 6).alias("audio_duration_sum"),
        F.size(slide).alias("visual_count"), P.best(prov, "slide").alias("visual_quality_max"), F.coalesce(chart, F.lit(False)).cast("double").alias("visual_has_chart"),
        F.size(paper).alias("paper_count"), P.best(prov, "paper").alias("paper_quality_max"),
        F.size(F.filter(paper, lambda p: F.coalesce(p["is_repaired"], F.lit(False)))).alias("paper_repaired_count"),
        F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform(paper, lambda p: p["similarity_score"]))), F.lit(0.0)).alias("paper_similarity_max"),
    )


def source_type(tier: Column, is_repaired: Column, hard_negative: Column) -> tuple[Column, Column]:
    """(source_type, base_tier) of a training edge."""
    t, rep = known_tier(tier), F.coalesce(is_repaired, F.lit(False))
    return F.when(hard_negative, "hard_negative").when(rep, "repaired").otherwise(t), F.when(~hard_negative & rep, t)


def incidence(triples: DataFrame) -> DataFrame:
    """(node, triple) of both ends of every distinct triple: the graph's adjacency."""
    t = triples.where("head_id is not null and tail_id is not null").select("head_id", "relation", "tail_id", "head_type", "tail_type").dropDuplicates(["head_id", "relation", "tail_id"])
    return t.select(F.explode(F.array_distinct(F.array("head_id", "tail_id"))).alias("node_id"), "head_id", "relation", "tail_id", "tail_type")


def hyperedges(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Per node with evidence: tail types and relations of its incident triples, evidence counts, and how many modalities it has.

    Distinct types and relations are counted before they meet, so a node of many edges is a few rows.
    """
    inc = incidence(triples).groupBy("node_id").agg(F.countDistinct("tail_type").alias("n_tail_types"), F.countDistinct("relation").alias("n_relations"), F.count("*").alias("n_triples"))
    size = lambda c: F.max(F.coalesce(F.size(c), F.lit(0)))
    ev = links.where("node_id is not null").groupBy("node_id").agg(size("utterances").alias("n_utterances"), F.greatest(size("slides"), size("visual_regions")).alias("n_visual"), size("paper_chunks").alias("n_paper"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_mod = sum(((F.col(c) > 0).cast("int") for c in ("n_utterances", "n_visual", "n_paper")), F.lit(0))
    return ev.join(inc, "node_id", "left").select("node_id", zero("n_tail_types").alias("n_tail_types"), zero("n_relations").alias("n_relations"), zero("n_triples").alias("n_triples"), "n_utterances", "n_visual", "n_paper", n_mod.alias("modality_count"))


def anchor_expansion(anchors: DataFrame, triples: DataFrame, links: DataFrame, cap: int = 15) -> DataFrame:
    """Per anchor node: up to cap distinct triples at its evidence (chunks, slides, utterances, regions) that is not an anchor itself, by evidence id and triple."""
    ids = F.array_distinct(F.filter(F.flatten(F.array(
        F.coalesce("paper_chunks.chunk_id", F.array().cast("array<string>")), F.coalesce("slides.slide_id", F.array().cast("array<string>")),
        F.coalesce("utterances.utterance_id", F.array().cast("array<string>")), F.coalesce("visual_regions.region_id", F.array().cast("array<string>")),
    )), lambda x: x.isNotNull()))
    ev = links.join(anchors.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.explode(ids).alias("evidence_id")).distinct()
    ev = ev.join(anchors.select(F.col("node_id").alias("evidence_id")).distinct(), "evidence_id", "left_anti")
    inc = incidence(triples).withColumnRenamed("node_id", "evidence_id")
    hit = ev.join(inc, "evidence_id").groupBy("node_id", "head_id", "relation", "tail_id").agg(F.min("evidence_id").alias("evidence_id"))
    w = Window.partitionBy("node_id").orderBy("evidence_id", "head_id", "relation", "tail_id")
    return hit.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= cap)
