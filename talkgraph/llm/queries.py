"""Queries of the problems for language-model training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgraph.llm import copies, encode, fusion, leaks, mojibake, nearest, overlaps, pairs, scans


def load(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    regions, chunks = load(spark, d, "visual_regions", "paper_chunks")
    return scans.cleaned(
        regions.select(F.lit("visual_regions").alias("source_table"), F.col("region_id").alias("row_key"), F.col("sample_id").alias("session"), scans.page_of("slide_id").alias("page"), F.col("ocr_text").alias("text"))
        .union(chunks.select(F.lit("paper_chunks"), "chunk_id", "sample_id", "page", "text"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("source_table", "row_key", F.explode("noise").alias("noise")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each text as clean continuous paragraphs, with the noise found in it."""
    return _scanned(spark, d).withColumn("noise", F.array_join("noise", ","))


COPY_KEY = {"id_col": "triple_id", "exact": ["sample_id", "relation"], "text": ["head_content", "tail_content"]}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    (kg,) = load(spark, d, "kg_triples")
    return copies.members(kg, **COPY_KEY)


def p2_statements(spark: SparkSession, d: str) -> DataFrame:
    """One record per statement, with its number of copies."""
    (kg,) = load(spark, d, "kg_triples")
    return copies.collapsed(kg, copies.members(kg, **COPY_KEY), "triple_id").select("triple_id", "sample_id", "relation", "n_copies")


_GAP = r"[\s\p{Z}\p{C}\p{P}\p{S}]"


def _normal_sql(x: str) -> str:
    """The same normal form in RE2, which has no look-around: numbers are marked by letters of a private area."""
    m, p = "\ue001", "\ue002"
    x = f"' ' || lower({x}) || ' '"
    for _ in range(2):
        x = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}\\p{{M}}.])[-−‐-—]([.]?\\p{{Nd}})', '\\1{m}\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\p{{Nd}}\\s\\p{{Z}}{m}])[.](\\p{{Nd}})', '\\1{p}\\2', 'g')"
    gap = f"(?:[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\p{{P}}\\p{{S}}])+"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\p{{Nd}}){gap}(\\p{{Nd}})', '\\1\ue003\\2', 'g')"
    x = f"regexp_replace({x}, '{gap}', '', 'g')"
    return x


def _pieces_sql(c: str) -> str:
    return f"list_sort(list_filter(list_transform(string_split(replace({c}, '|', ';'), ';'), lambda x: {_normal_sql('x')}), lambda y: y <> ''))"


_GROUPS = f"""
with n as (select triple_id, sample_id, relation, {_pieces_sql('head_content')} h, {_pieces_sql('tail_content')} t from kg_triples),
g as (select triple_id, sample_id, relation, min(triple_id) over (partition by sample_id, relation, h, t) keep_id, count(*) over (partition by sample_id, relation, h, t) n_copies from n)
"""

P6_SQL = """
with b as (select triple_id, sample_id, signal_source, weight,
    coalesce(list_max(list_filter(list_transform(provenance, lambda p: p.similarity_score), lambda x: x is not null)), -1) sim,
    case regexp_replace(lower(tier), '[^a-z]', '', 'g') when 'strong' then 2 when 'medium' then 1 else 0 end lvl from kg_triples),
w as (select *, case when weight is null then -1 else
    (rank() over (partition by signal_source, weight is null order by weight) - 1)::double / count(*) over (partition by signal_source, weight is null) end pct from b),
r as (select *, rank() over (partition by sample_id order by pct desc) rw, rank() over (partition by sample_id order by sim desc) rs,
    rank() over (partition by sample_id order by lvl desc) rt from w),
s as (select *, 1.0::double/(rw+60) + 1.0::double/(rs+60) + 1.0::double/(rt+60) rrf from r),
k as (select *, row_number() over (partition by sample_id order by rrf desc, triple_id) place from s)
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    (kg,) = load(spark, d, "kg_triples")
    return fusion.top(kg, 5).select("sample_id", "triple_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking: every triple of every session with its three ranks and fused score."""
    (kg,) = load(spark, d, "kg_triples")
    return fusion.ranked(kg).select("sample_id", "triple_id", "weight_rank", "similarity_rank", "tier_rank", "rrf")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    (results,) = load(spark, d, "results")
    return pairs.defects(results)


#: Seconds within which an utterance is given a slide.
SLIDE_TOLERANCE = 12.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(spark, (f"{d}/utterances.parquet", "utterance_id", "start_time"), (f"{d}/slides.parquet", "slide_id", "start_time"), "sample_id", SLIDE_TOLERANCE)
    return found.selectExpr("left_id as utterance_id", "right_id as slide_id").distinct()


P3_SQL = """
with u as (select distinct sample_id, utterance_id, start_time from utterances where start_time is not null),
s as (select distinct sample_id, slide_id, start_time from slides where start_time is not null),
j as (select utterance_id, slide_id, row_number() over (partition by u.sample_id, utterance_id, u.start_time order by abs(u.start_time - s.start_time), s.start_time, slide_id) k
  from u join s on u.sample_id = s.sample_id and abs(u.start_time - s.start_time) <= 12.0)
select distinct utterance_id, slide_id from j where k = 1
"""


def _overlaps(spark: SparkSession, d: str) -> dict[str, tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]]:
    """source -> (pairs of classes and members, (key, split) of the evaluation side)."""
    gold, train, edges = load(spark, d, "gold_test", "decomposer_train", "supervision")
    held = edges.where("split in ('dev', 'test')")
    return {
        "question": (overlaps.overlaps(gold, train, "qa_id", ["question"], question=True), gold.selectExpr("qa_id key", "split")),
        "edge": (overlaps.overlaps(held, edges.where("split = 'train'"), "sample_key", ["head_content", "tail_content"], group="relation"), held.selectExpr("sample_key key", "split")),
    }


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = [overlaps.expanded(*got).select(F.lit(source).alias("source"), F.least("eval_key", "train_key").alias("key_a"), F.greatest("eval_key", "train_key").alias("key_b")) for source, (got, _) in _overlaps(spark, d).items()]
    return pairs[0].union(pairs[1]).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts per source and evaluation split, from classes of copies and their sizes."""
    out = []
    for source, ((pairs, held, train), splits) in _overlaps(spark, d).items():
        met = pairs.join(held.join(splits.distinct(), "key").groupBy(F.col("cls").alias("eval_cls"), "split").agg(F.count("*").alias("ne")), "eval_cls")
        met = met.join(train.groupBy(F.col("cls").alias("train_cls")).agg(F.count("*").alias("nt")), "train_cls").select(F.lit(source).alias("source"), "split", "eval_cls", "train_cls", "ne", "nt")
        once = lambda cls, n, name: met.select("source", "split", cls, n).distinct().groupBy("source", "split").agg(F.sum(n).alias(name))  # noqa: B023, E731
        total = met.groupBy("source", "split").agg(F.sum(F.col("ne") * F.col("nt")).alias("n_pairs"))
        out.append(total.join(once("eval_cls", "ne", "n_eval"), ["source", "split"]).join(once("train_cls", "nt", "n_train"), ["source", "split"]))
    return out[0].union(out[1])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    return encode.token_ids(docs, "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = load(spark, d, "documents", "heldout_passages")
    return leaks.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents and how much of them at most."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("max_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = load(spark, d, "documents")
    return mojibake.restored(docs, "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    (docs,) = load(spark, d, "documents")
    return mojibake.restored(docs, "doc_id", "text")


QUERIES = {"p4_found": p4_found, "p1_found": p1_found, "p1_clean": p1_clean, "p7_found": p7_found, "p7_report": p7_report, "p9_found": p9_found, "p9_items": p9_items, "p8_ids": p8_ids, "p10_found": p10_found, "p10_restored": p10_restored, "p3_found": p3_found, "p2_found": p2_found, "p2_statements": p2_statements, "p6_found": p6_found, "p6_ranking": p6_ranking}
SQL = {
    "p3_found": P3_SQL,
    "p2_found": _GROUPS + "select keep_id, triple_id from g where keep_id < triple_id",
    "p2_statements": _GROUPS + "select triple_id, sample_id, relation, n_copies from g where triple_id = keep_id",
    "p6_found": P6_SQL + "select sample_id, triple_id from k where place <= 5",
    "p6_ranking": P6_SQL + "select sample_id, triple_id, rw weight_rank, rs similarity_rank, rt tier_rank, rrf from k",
}
