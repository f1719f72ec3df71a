"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkgraph.operators import orphans


def load(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kg, links, slides, regions, chunks, utterances = load(spark, d, "kg_triples", "evidence_links", "slides", "visual_regions", "paper_chunks", "utterances")
    refs = orphans.triple_refs(kg).union(orphans.region_refs(links))
    return orphans.orphans(refs, orphans.parents(slides, regions, chunks, utterances, links))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, d))


P5_SQL = """
with parents as (
  select 'slide' kind, slide_id id, written_at born, null::timestamp gone from slides
  union all select 'region', region_id, written_at, deleted_at from visual_regions
  union all select 'chunk', chunk_id, written_at, deleted_at from paper_chunks
  union all select 'utterance', utterance_id, written_at, null from utterances
  union all select 'node', node_id, written_at, deleted_at from evidence_links),
ends as (
  select triple_id, written_at ref_at, 'head_id' ref_field, head_type t, head_id ref_id from kg_triples
  union all select triple_id, written_at, 'tail_id', tail_type, tail_id from kg_triples),
refs as (
  select 'kg_triples' source_table, triple_id::varchar source_key, ref_field, ref_id, ref_at,
    case when t = 'Slide' then 'slide' when t = 'VisualRegion' then 'region' when t = 'PaperChunk' then 'chunk' when t = 'Utterance' then 'utterance'
         when t in ('Claim','Method','Dataset','Metric','Result','Limitation') then 'node' end kind
  from ends
  union all
  select 'evidence_links', node_id, 'region_id', r.region_id, written_at, 'region' from (select node_id, written_at, unnest(visual_regions) r from evidence_links)),
judged as (
  select source_table, source_key, ref_field, ref_id, ref_at, count(p.id) n,
    count(*) filter (where p.born is null or p.born <= ref_at) in_time,
    count(*) filter (where (p.born is null or p.born <= ref_at) and (p.gone is null or p.gone > ref_at)) fine
  from refs left join parents p on p.kind = refs.kind and p.id = refs.ref_id
  where refs.kind is not null and ref_id is not null
  group by all)
select distinct source_table, source_key, ref_field, ref_id,
  case when n = 0 then 'missing' when in_time = 0 then 'late' else 'deleted' end status, strftime(ref_at, '%Y-%m') period
from judged where n = 0 or fine = 0
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": P5_SQL,
    "p5_report": f"select source_table, ref_field, status, period, count(*) n_refs, count(distinct ref_id) n_ids from ({P5_SQL}) group by all",
}
