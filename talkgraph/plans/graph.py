"""Queries over triples and evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import provenance as P
from talkgraph.operators import triples as T


def kg(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/kg_triples.parquet")


def links(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/evidence_links.parquet")


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_ALLOWED = "(values " + ", ".join(f"('{h}','{r}','{t}')" for h, r, t in O.allowed()) + ") al(h, r, t)"
_ST = "lower(trim(coalesce(p.source_type, '')))"
_MOD = f"""case when {_ST} = 'audio' then 'audio' when {_ST} in ('slide','slide_region','visual_region') then 'slide'
 when {_ST} in ('paper','paper_chunk','figure','table') then 'paper' when p.slide_id is not null or p.region_id is not null then 'slide'
 when p.chunk_id is not null or p.page is not null then 'paper' end"""
_BOX = "coalesce(len(p.bbox) = 4, false)"
_QUAL = f"""case ({_MOD}) when 'audio' then case when coalesce(p.end_time > p.start_time, false) then 1.0 else 0.6 end
 when 'slide' then case when trim(coalesce(p.region_id,'')) <> '' and {_BOX} then 1.0 when trim(coalesce(p.slide_id,'')) <> '' then 0.6 else 0.0 end
 when 'paper' then case when coalesce(p.is_repaired,false) and trim(coalesce(p.repair_method,'')) = 'dense_retrieval' then 0.9
   when trim(coalesce(p.chunk_id,'')) <> '' and (p.page is not null or {_BOX}) then 1.0
   when trim(coalesce(p.source_type,'')) in ('figure','table') and (p.page is not null or {_BOX}) then 1.0
   when trim(coalesce(p.chunk_id,'')) <> '' or p.page is not null or {_BOX} then 0.6 else 0.0 end else 0.0 end::double"""


def _w(i: int) -> str:
    return "case relation " + " ".join(f"when '{r}' then {w[i]}" for r, w in O.WEIGHTS.items()) + " else 0 end::double"


_ITEMS = f"""items as (select triple_id, relation, p, {_MOD} m, {_QUAL} q from (select triple_id, relation, unnest(list_distinct(provenance)) p from kg_triples)),
best as (select triple_id, coalesce(max(q) filter (where m='audio'),0) qa, coalesce(max(q) filter (where m='slide'),0) qs, coalesce(max(q) filter (where m='paper'),0) qp,
  bool_or(coalesce(p.is_repaired,false)) rep, bool_or(coalesce(p.is_repaired,false) and trim(coalesce(p.repaired_granularity,''))='page_level' and m is not null) pg from items group by 1)"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select sample_id, relation, count(*) n from kg_triples group by all")
def a01_relation_counts(s, d):
    return kg(s, d).groupBy("sample_id", "relation").agg(F.count("*").alias("n"))


@query("select node_type, count(distinct node_id) n_nodes, count(*) n_rows from evidence_links group by all")
def a02_node_type_counts(s, d):
    return links(s, d).groupBy("node_type").agg(F.countDistinct("node_id").alias("n_nodes"), F.count("*").alias("n_rows"))


@query("select sample_id, count(*) filter (where t='strong') strong, count(*) filter (where t='medium') medium, count(*) filter (where t='weak') weak from (select sample_id, case when lower(trim(tier)) in ('strong','medium') then lower(trim(tier)) else 'weak' end t from kg_triples) group by 1")
def a03_tier_counts(s, d):
    return kg(s, d).groupBy("sample_id").agg(*(F.count_if(T.known_tier(F.col("tier")) == t).alias(t) for t in ("strong", "medium", "weak")))


_COV = f"select sample_id, count(*) filter (where relation in ({_in(O.LOGICAL)})) logical_total, count(*) filter (where relation in ('supported_by','measured_by')) supported_or_measured from kg_triples group by 1"


@query(f"select *, logical_total >= 3 and supported_or_measured >= 1 passed from ({_COV})")
def a04_coverage(s, d):
    return T.coverage(kg(s, d))


@query("""with k as (select *, coalesce(weight,0) w, row_number() over (partition by head_id, relation, tail_id order by coalesce(weight,0) desc, triple_id) rk from kg_triples)
select head_id, relation, tail_id, count(*) n_rows, case when count(*) > 1 then round(max(w),4) else max(w) end weight,
 case when min(signal_source) <> max(signal_source) then 'hybrid' else max(signal_source) filter (where rk=1) end signal_source,
 len(list_distinct(flatten(list(provenance)))) n_prov, bool_or(coalesce(is_repaired,false)) is_repaired from k group by 1,2,3""")
def a05_dedupe_triples(s, d):
    return T.merged(kg(s, d)).select("head_id", "relation", "tail_id", "n_rows", "weight", "signal_source", F.size("provenance").alias("n_prov"), "is_repaired")


@query("select triple_id, len(provenance) n_items, len(list_distinct(provenance)) n_distinct from kg_triples where provenance is not null")
def a06_provenance_distinct(s, d):
    return kg(s, d).where("provenance is not null").select("triple_id", F.size("provenance").alias("n_items"), F.size(F.array_distinct("provenance")).alias("n_distinct"))


@query(f"""with {_ITEMS},
sc as (select k.triple_id, greatest(0.0, least(1.0, ({_w(0)})*coalesce(qa,0) + ({_w(1)})*coalesce(qs,0) + ({_w(2)})*coalesce(qp,0))) sc,
  coalesce(is_repaired,false) or coalesce(rep,false) rep, coalesce(pg,false) pg from kg_triples k left join best b using (triple_id) where provenance is not null)
select triple_id, round(sc,4) provenance_score, case when sc >= 0.75 then case when rep and pg then 'medium' else 'strong' end when sc >= 0.45 then 'medium' else 'weak' end tier, rep is_repaired from sc""")
def a07_provenance_score(s, d):
    return T.scored(kg(s, d).where("provenance is not null")).select("triple_id", "provenance_score", "tier", "is_repaired")


@query(f"""with {_ITEMS.split("best as")[0].rstrip().rstrip(",").replace("list_distinct(provenance)", "provenance")},
f as (select k.triple_id, k.relation, coalesce(bool_or(m='audio'),false) a, coalesce(bool_or(m='slide'),false) s, coalesce(bool_or(m='paper'),false) p from kg_triples k left join items i using (triple_id) where trim(k.relation) <> '' group by 1,2),
e as (select *, (({_w(0)})>0)::int ea, (({_w(1)})>0)::int es, (({_w(2)})>0)::int ep from f)
select relation, count(*) edges, round(avg(case when ea+es+ep > 0 then (ea*a::int + es*s::int + ep*p::int)::double/(ea+es+ep) else 1 end),4) avg_expected_coverage,
 count(*) filter (where a) with_audio, count(*) filter (where s) with_slide, count(*) filter (where p) with_paper from e group by 1""")
def a08_completeness(s, d):
    return T.completeness(kg(s, d))


@query(f"""with b as ({_COV}),
t as (select sample_id, count(*) filter (where lower(trim(tier))='strong') strong, count(*) filter (where lower(trim(tier))='medium') medium, count(*) filter (where coalesce(lower(trim(tier)),'') not in ('strong','medium')) weak,
  count(*) filter (where coalesce(len(provenance),0)=0) missing_provenance from kg_triples group by 1),
e0 as (select sample_id, coalesce(tail_id,'') tail, count(*) n from kg_triples where relation='emphasizes' group by all),
e as (select sample_id, sum(n)::bigint emph_total, count(*) emph_tails, round(max(n)::double/sum(n),4) dominant_ratio from e0 group by 1),
v as (select sample_id, sum(coalesce(len(visual_regions),0))::bigint rt, sum(coalesce(len(list_filter(visual_regions, lambda r: trim(coalesce(r.ocr_text,''))<>'' or trim(coalesce(r.visual_summary,''))<>'')),0))::bigint rs from evidence_links group by 1)
select b.sample_id, logical_total, supported_or_measured, strong, medium, weak, missing_provenance, coalesce(emph_total,0) emph_total, coalesce(emph_tails,0) emph_tails, coalesce(dominant_ratio,0) dominant_ratio,
 coalesce(rt,0) regions_total, round(coalesce(rs,0)::double/greatest(1,coalesce(rt,0)),4) visual_coverage,
 case when logical_total>=3 and supported_or_measured>=1 and not (coalesce(rt,0)>0 and coalesce(rs,0)=0) then 'ok' else 'failed_coverage' end quality_status
from b join t using (sample_id) left join e using (sample_id) left join v using (sample_id)""")
def a09_quality_report(s, d):
    return T.quality_report(kg(s, d), links(s, d))


_SUMMARY = f"""with items as (select sample_key, p, {_MOD} m, {_QUAL} q from (select sample_key, unnest(provenance) p from supervision))
select k.sample_key, count(m) filter (where m='audio') audio_count, coalesce(max(q) filter (where m='audio'),0) audio_quality_max,
 round(coalesce(sum(case when p.end_time > p.start_time then p.end_time - p.start_time else 0 end) filter (where m='audio'),0),6) audio_duration_sum,
 count(m) filter (where m='slide') visual_count, coalesce(max(q) filter (where m='slide'),0) visual_quality_max,
 coalesce(bool_or(trim(coalesce(p.chart_type,'')) not in ('','none')) filter (where m='slide'),false)::int::double visual_has_chart,
 count(m) filter (where m='paper') paper_count, coalesce(max(q) filter (where m='paper'),0) paper_quality_max,
 count(m) filter (where m='paper' and coalesce(p.is_repaired,false)) paper_repaired_count, greatest(0, coalesce(max(p.similarity_score) filter (where m='paper'),0)) paper_similarity_max
from (select distinct sample_key from supervision where provenance is not null) k left join items using (sample_key) group by 1"""


@query(_SUMMARY)
def a11_modality_summary(s, d):
    return T.modality_summary(s.read.parquet(f"{d}/supervision.parquet").where("provenance is not null"), ["sample_key"])


@query(f"select m modality, q quality, count(*) n from (select {_MOD} m, {_QUAL} q from (select unnest(provenance) p from kg_triples)) group by all")
def f12_item_quality(s, d):
    items = kg(s, d).select(F.explode("provenance").alias("p"))
    return items.select(P.modality(F.col("p")).alias("modality"), P.quality(F.col("p")).alias("quality")).groupBy("modality", "quality").agg(F.count("*").alias("n"))


_VALID = f"""select distinct sample_id, head_id, relation, tail_id, least(1.0, greatest(0.0, coalesce(weight, 0.6))) weight, coalesce(nullif(trim(signal_source),''),'semantic') signal_source, provenance
from kg_triples semi join {_ALLOWED} on h = head_type and r = relation and t = tail_type
where trim(coalesce(head_id,''))<>'' and trim(coalesce(tail_id,''))<>'' and trim(coalesce(head_content,''))<>'' and trim(coalesce(tail_content,''))<>'' and len(provenance)>0"""


@query(f"select sample_id, head_id, relation, tail_id, weight, signal_source, len(provenance) n_prov from ({_VALID})")
def pred02_valid_triples(s, d):
    return T.valid(kg(s, d)).select("sample_id", "head_id", "relation", "tail_id", "weight", "signal_source", F.size("provenance").alias("n_prov"))


@query(f"select relation, count(*) n from kg_triples semi join {_ALLOWED} on h = head_type and r = relation and t = tail_type group by 1")
def pred03_relation_allowed(s, d):
    return T.relation_allowed(kg(s, d)).groupBy("relation").agg(F.count("*").alias("n"))


@query("select triple_id, least(1.0, greatest(0.0, coalesce(weight, 0.6))) weight from kg_triples")
def pred04_clean_weight(s, d):
    return kg(s, d).select("triple_id", T.clean_weight(F.col("weight")).alias("weight"))


@query(f"select m modality, count(distinct triple_id) n from (select triple_id, {_MOD} m from (select triple_id, unnest(provenance) p from kg_triples)) where m is not null group by 1")
def pred05_triples_by_modality(s, d):
    return kg(s, d).select("triple_id", F.explode(F.array_distinct(F.transform("provenance", P.modality))).alias("modality")).where("modality is not null").groupBy("modality").agg(F.countDistinct("triple_id").alias("n"))


@query("select triple_id, case when coalesce(is_repaired,false) then 'repaired' else t end source_type, case when coalesce(is_repaired,false) then t end base_tier from (select triple_id, is_repaired, case when lower(trim(tier)) in ('strong','medium') then lower(trim(tier)) else 'weak' end t from kg_triples)")
def f13_source_type(s, d):
    st, base = T.source_type(F.col("tier"), F.col("is_repaired"), F.lit(False))
    return kg(s, d).select("triple_id", st.alias("source_type"), base.alias("base_tier"))


_INC = """t as (select head_id, relation, tail_id, min(tail_type) tail_type from kg_triples where head_id is not null and tail_id is not null group by 1,2,3),
inc as (select head_id node_id, * from t union all select tail_id, * from t where tail_id <> head_id)"""


@query(f"with {_INC} select node_id, count(*) degree, count(distinct relation) n_relations from inc group by 1")
def j13_adjacency(s, d):
    return T.incidence(kg(s, d)).groupBy("node_id").agg(F.count("*").alias("degree"), F.countDistinct("relation").alias("n_relations"))


@query(f"""with {_INC}, i as (select node_id, count(distinct tail_type) a, count(distinct relation) b, count(*) c from inc group by 1),
e as (select node_id, max(coalesce(len(utterances),0)) u, greatest(max(coalesce(len(slides),0)), max(coalesce(len(visual_regions),0))) v, max(coalesce(len(paper_chunks),0)) p from evidence_links where node_id is not null group by 1)
select node_id, coalesce(a,0) n_tail_types, coalesce(b,0) n_relations, coalesce(c,0) n_triples, u n_utterances, v n_visual, p n_paper, (u>0)::int+(v>0)::int+(p>0)::int modality_count from e left join i using (node_id)""")
def j16_hyperedges(s, d):
    return T.hyperedges(kg(s, d), links(s, d))


@query(f"""with {_INC},
a as (select distinct node_id from evidence_links where node_id is not null),
ids as (select node_id, unnest(list_transform(paper_chunks, lambda x: x.chunk_id)) e from evidence_links union select node_id, unnest(list_transform(slides, lambda x: x.slide_id)) from evidence_links
 union select node_id, unnest(list_transform(utterances, lambda x: x.utterance_id)) from evidence_links union select node_id, unnest(list_transform(visual_regions, lambda x: x.region_id)) from evidence_links),
ev as (select distinct node_id, e from ids semi join a using (node_id) where e is not null and e not in (select node_id from a)),
h as (select ev.node_id, head_id, relation, tail_id, min(e) evidence_id from ev join inc on inc.node_id = ev.e group by all),
r as (select *, row_number() over (partition by node_id order by evidence_id, head_id, relation, tail_id) rk from h)
select node_id, head_id, relation, tail_id, evidence_id, rk from r where rk <= 15""")
def j17_anchor_expansion(s, d):
    return T.anchor_expansion(links(s, d).where("node_id is not null").select("node_id"), kg(s, d), links(s, d))


@query("select substr(h, 1, 400) session_id, count(*) n from (select array_to_string(string_split(head_id, '/')[1:2], '/') h from kg_triples where head_id is not null and len(string_split(head_id,'/')) >= 2) group by 1")
def f31_session_of_node(s, d):
    return kg(s, d).where("head_id is not null and instr(head_id, '/') > 0").select(F.substring_index("head_id", "/", 2).alias("session_id")).groupBy("session_id").agg(F.count("*").alias("n"))


@query("select coalesce(sample_id, 'all') sample_id, coalesce(relation, 'all') relation, count(*) n, count(*) filter (where lower(trim(tier)) in ('strong','medium')) n_kept from kg_triples group by rollup(sample_id, relation)")
def a26_rollup_report(s, d):
    kept = F.lower(F.trim("tier")).isin("strong", "medium")
    return kg(s, d).rollup("sample_id", "relation").agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept")).select(F.coalesce("sample_id", F.lit("all")).alias("sample_id"), F.coalesce("relation", F.lit("all")).alias("relation"), "n", "n_kept")
