"""Queries of evidence, repairs and recordings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.operators import audio as A
from talkgraph.operators import evidence as E
from talkgraph.operators import providers
from talkgraph.plans import learning
from talkgraph.plans.graph import _MOD
from talkgraph.plans.timeline import prosody, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def alignment(s, d) -> DataFrame:
    return E.aligned(table(s, d, "utterances"), table(s, d, "slides"), table(s, d, "visual_regions"))


_T = "list_distinct(regexp_extract_all(lower(coalesce({0},'')),'[a-z0-9_]+'))"


@query("select slide_id, n, x0, y0, x1, y1 from (select distinct slide_id, image_width w, image_height h from slides where image_width is not null and image_height is not null), lateral (select unnest([{'n':0,'x0':0,'y0':0,'x1':w,'y1':h},{'n':1,'x0':0,'y0':0,'x1':w//2,'y1':h//2},{'n':2,'x0':w//2,'y0':0,'x1':w,'y1':h//2},{'n':3,'x0':0,'y0':h//2,'x1':w//2,'y1':h},{'n':4,'x0':w//2,'y0':h//2,'x1':w,'y1':h}], recursive := true))")
def f21_grid_regions(s, d):
    return E.grid_regions(table(s, d, "slides").where("image_width is not null and image_height is not null").select("slide_id", "image_width", "image_height").distinct())


_ALIGNED = """with u as (select distinct sample_id, utterance_id, start_time us from utterances where start_time is not null), s as (select distinct sample_id, slide_id, start_time s, end_time e from slides where start_time is not null),
l as (select *, row_number() over (partition by sample_id order by s desc, slide_id desc, coalesce(e,'inf'::double) desc) = 1 is_last from s),
h as (select u.sample_id, utterance_id, us, slide_id, row_number() over (partition by u.sample_id, utterance_id, us order by s, slide_id) k from u join l on l.sample_id = u.sample_id and s <= us and (e is null or us < e or is_last)),
ua as (select u.utterance_id, slide_id from u left join (select * from h where k = 1) h on h.sample_id = u.sample_id and h.utterance_id = u.utterance_id and h.us = u.us),
sc as (select slide_id, region_id, max(case when trim(coalesce(ocr_text,''))<>'' then 2 else 0 end + case when trim(coalesce(visual_summary,''))<>'' then 2 else 0 end + case when trim(coalesce(chart_type,'')) not in ('','none') then 2 else 0 end + case when coalesce(len(entities),0)>0 then 1 else 0 end) score from visual_regions where slide_id is not null group by 1,2),
r as (select * from (select slide_id, region_id, row_number() over (partition by slide_id order by score desc, region_id) rk from sc) where rk <= 3)
select utterance_id, slide_id, region_id, rk from ua left join r using (slide_id)"""


@query(_ALIGNED)
def c06_alignment_context(s, d):
    return alignment(s, d)


@query(f"""with al0 as ({_ALIGNED}), al as (select distinct utterance_id u, slide_id, region_id from al0 where slide_id is not null and (rk = 1 or rk is null)), dr as (select slide_id, min(region_id) d from visual_regions where slide_id is not null group by 1),
t as (select * from kg_triples where triple_id is not null and (relation='aligned_to_slide' or (relation='referenced_by' and head_type='VisualRegion')) and len(list_filter(coalesce(provenance,[]), lambda p: ({_MOD}) = 'slide')) = 0),
vr as (select region_id, min(slide_id) slide_id from visual_regions where region_id is not null group by 1), e as (select triple_id, 0 e, head_id id, head_type ty from t where head_id is not null union all select triple_id, 1, tail_id, tail_type from t where tail_id is not null),
sd as (select id, min(u) u from (select unnest(list_transform(prosody_events, lambda x: x.event_id)) id, utterances[1].utterance_id u from evidence_links where len(utterances) > 0) where id is not null group by 1),
ev as (select node_id id, unnest(range(len(utterances))) p, unnest(list_transform(utterances, lambda x: x.utterance_id)) u from evidence_links where node_id is not null),
c as (select triple_id, id u, 0 a, e b, 0 c from e where ty='Utterance' union all select triple_id, u, 1, e, 0 from e join sd using (id) where ty='ProsodyEvent' union all select triple_id, u, 2, e, p from e join ev using (id)),
f as (select *, row_number() over (partition by triple_id, u order by a, b, c) q from c where trim(coalesce(u,'')) <> ''), k as (select *, row_number() over (partition by triple_id order by a, b, c, u) pos from f where q = 1),
o as (select triple_id, 0 stage, 0 pos, 0 how, vr.slide_id, vr.region_id, 'head_visual_region_anchor' reason from t join vr on vr.region_id = t.head_id where relation='referenced_by'
 union all select triple_id, 1, pos, case when region_id is not null then 0 when d is not null then 1 else 2 end, al.slide_id, coalesce(region_id, d), case when region_id is not null then 'utterance_alignment' when d is not null then 'slide_default_region' else 'slide_page' end from k join al using (u) left join dr on dr.slide_id = al.slide_id where pos <= 12)
select triple_id, slide_id, region_id, reason from (select *, row_number() over (partition by triple_id order by stage, pos, how, slide_id nulls first, region_id nulls first) r from o) where r = 1""")
def c11_slide_repairs(s, d):
    return E.slide_repairs(table(s, d, "kg_triples"), table(s, d, "evidence_links"), alignment(s, d), table(s, d, "visual_regions"))


@query(f"""select relation, count(*) n from kg_triples where (relation='aligned_to_slide' or (relation='referenced_by' and head_type='VisualRegion')) and len(list_filter(coalesce(provenance,[]), lambda p: ({_MOD}) = 'slide')) = 0 group by 1""")
def c11_repair_targets(s, d):
    return E.repair_targets(table(s, d, "kg_triples")).groupBy("relation").agg(F.count("*").alias("n"))


@query()
def j29_paper_repairs(s, d):
    """Edges without paper evidence and the nearest chunk of their session, by the offline embedding."""
    return E.near_chunks(table(s, d, "kg_triples"), table(s, d, "paper_chunks"))


@query(f"""with n as (select sample_id, node_id, node_type type, min("content") c, coalesce(max(confidence),0) f from evidence_links where node_id is not null and node_type in ('Claim','Method','Result','Metric','Limitation') group by 1,2,3),
t as (select *, {_T.format('c')} tk from n), p as (select a.node_id claim_id, b.node_id, b.type, round(case when least(len(a.tk),len(b.tk))=0 then 0 else len(list_intersect(a.tk,b.tk))::double/least(len(a.tk),len(b.tk)) end + 0.1::double*b.f,6) score from t a join t b on a.sample_id=b.sample_id and a.type='Claim' and b.type<>'Claim')
select claim_id, node_id, type, score, rk from (select *, row_number() over (partition by claim_id, type order by score desc, node_id) rk from p) where rk <= case type when 'Method' then 2 when 'Limitation' then 1 else 3 end""")
def j11_related_nodes(s, d):
    n = table(s, d, "evidence_links").where("node_id is not null").groupBy("sample_id", "node_id", F.col("node_type").alias("type")).agg(F.min("content").alias("content"), F.max("confidence").alias("confidence"))
    return E.related_nodes(n)


@query(f"""with r as ({SQL['j11_related_nodes']}), o as (select distinct claim_id, claim_id node_id, 0 o from r union all select claim_id, node_id, case type when 'Method' then 1 when 'Result' then 2 when 'Metric' then 3 else 4 end * 100 + rk from r),
c as (select node_id, unnest(range(len(paper_chunks))) p, unnest(list_transform(paper_chunks, lambda x: x.chunk_id)) chunk_id from evidence_links where node_id is not null), f as (select claim_id, chunk_id, min({{'o':o,'p':p}}) k from o join c using (node_id) where chunk_id is not null group by 1,2)
select claim_id, chunk_id, pos from (select claim_id, chunk_id, row_number() over (partition by claim_id order by k, chunk_id) pos from f) where pos <= 12""")
def j12_claim_evidence(s, d):
    return E.claim_evidence(j11_related_nodes(s, d), table(s, d, "evidence_links"))


@query()
def pred09_distinct_summaries(s, d):
    return E.distinct_summaries(table(s, d, "visual_regions"))


@query()
def w06_asr_chunks(s, d):
    """Ranges to transcribe of each session, cut at its pauses."""
    dur = table(s, d, "utterances").where("end_time is not null and abs(end_time) < double('infinity')").groupBy("sample_id").agg(F.max("end_time").alias("duration"))
    return A.cut_ranges(dur, prosody(s, d)).select("sample_id", "i", "s", "e")


@query("select utterance_id, i, round(a+i*2.0::double,3) s, round(least(b,a+(i+1)*2.0::double),3) e from (select distinct utterance_id, start_time a, end_time b from utterances where end_time > start_time), lateral (select unnest(range(greatest(1,ceil((b-a)/2.0::double)::int)))::int i)")
def w07_fixed_ranges(s, d):
    u = table(s, d, "utterances").where("end_time > start_time").select("utterance_id", "start_time", "end_time").distinct()
    return u.select("utterance_id", F.posexplode(A.fixed_ranges(F.col("start_time"), F.col("end_time"), 2.0)).alias("i", "r")).select("utterance_id", "i", "r.s", "r.e")


@query()
def w08_segment_dedup(s, d):
    """Each recording's segments without repeats of the last one kept."""
    u = table(s, d, "utterances").where("start_time is not null and end_time is not null").select("sample_id", F.col("start_time").alias("s"), F.col("end_time").alias("e"), "text")
    return A.without_overlaps(u).select("sample_id", "s", "e", F.length("text").alias("n_chars"))


_TIMED = "list_filter(word_timestamps, lambda w: w.start is not null and w.end is not null and trim(coalesce(w.text,'')) <> '' and w.end > w.start)"


@query(f"""with u as (select utterance_id, min(start_time) a, min(end_time) b from utterances group by 1), r as (select distinct utterance_id, unnest({_TIMED}) w from utterances),
o as (select utterance_id, w.start st, w.end en, row_number() over (partition by utterance_id order by w.start, w.end, w.text) k from r),
n as (select utterance_id, st, k, max(en - st) over (partition by utterance_id order by k rows between current row and 3 following) longest, count(*) over (partition by utterance_id order by k rows between current row and 3 following) m,
 greatest(coalesce(lead(st,1) over z - st, 0), coalesce(lead(st,2) over z - lead(st,1) over z, 0), coalesce(lead(st,3) over z - lead(st,2) over z, 0)) g from o window z as (partition by utterance_id order by k)),
f as (select utterance_id, min(st) onset from n where m = 4 and longest <= 1.2 and g <= 1.5 group by 1), l as (select utterance_id, min(st) onset from o where en - st <= 1.2 group by 1)
select utterance_id, coalesce(f.onset, l.onset, case when b - a >= 0.2 then a end) onset from u left join f using (utterance_id) left join l using (utterance_id)""")
def w09_speech_onset(s, d):
    """Onset of each utterance by its words, or else by its own span."""
    w = F.transform(F.filter("word_timestamps", lambda w: w["start"].isNotNull() & w["end"].isNotNull()), lambda w: F.struct(w["start"].alias("s"), w["end"].alias("e"), w["text"].alias("text")))
    u = table(s, d, "utterances").groupBy("utterance_id").agg(F.min("start_time").alias("s"), F.min("end_time").alias("e"), F.array_distinct(F.flatten(F.collect_set(w))).alias("w"))
    return u.select("utterance_id", A.speech_onset(F.col("w"), F.array(F.struct("s", "e"))).alias("onset"))


@query()
def w10_pitch_slope(s, d):
    """Slope over each user's signal of a day."""
    e = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("x"))
    return e.select("user_id", "day", F.round(A.pitch_slope(F.transform("x", lambda y: y["value"])), 6).alias("slope"))


@query()
def w13_semantic_windows(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(X.semantic_windows(F.col("text"))).alias("i", "w")).select("doc_id", "i", F.length("w").alias("n_chars"))


@query("select count(*) total, count(*) filter (where g = a) n_correct from (select coalesce(g <> '' and contains(a, g), false) ok, g, a from (select trim(regexp_replace(lower(coalesce(ground_truth_answer,'')),'[^\\p{L}\\p{N}]+',' ','g')) g, trim(regexp_replace(lower(coalesce(generated_answer,'')),'[^\\p{L}\\p{N}]+',' ','g')) a from results))".replace("count(*) filter (where g = a)", "count(*) filter (where ok)"))
def e11_offline_judge(s, d):
    return providers.judged(table(s, d, "results")).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("n_correct"))


@query()
def e01_embeddings(s, d):
    """Offline embeddings of all paper chunks."""
    c = table(s, d, "paper_chunks").where("text is not null").select("chunk_id", "text").distinct()
    return providers.embedded(c, "text").select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


def _listed(c: str) -> str:
    return f"{c}s as (select node_id, string_agg({c}_id, '|' order by q) {c}s from (select node_id, {c}_id, row_number() over (partition by node_id order by min(o), {c}_id) q from seen where {c}_id is not null group by 1,2) where q <= 3 group by 1)"


@query(f"""with n as (select distinct node_id from evidence_links where node_id is not null), u as ({learning.SQL['j09_overlap_topn']}), c as ({learning.SQL['j08_jaccard_topk']}), al as ({_ALIGNED}),
seen as (select node_id, u.utterance_id, slide_id, region_id, u.rk*100+coalesce(al.rk,0) o from u left join al using (utterance_id)), {_listed('utterance')}, {_listed('slide')}, {_listed('region')}, cs as (select node_id, string_agg(chunk_id, '|' order by rk) chunks from c group by 1)
select node_id, coalesce(utterances,'') utterances, coalesce(slides,'') slides, coalesce(regions,'') regions, coalesce(chunks,'') chunks from n left join utterances using (node_id) left join slides using (node_id) left join regions using (node_id) left join cs using (node_id)""".replace("utterances as (select node_id, string_agg", "utterancesx as (select node_id, string_agg").replace("slides as (select node_id, string_agg", "slidesx as (select node_id, string_agg").replace("regions as (select node_id, string_agg", "regionsx as (select node_id, string_agg").replace("left join utterances using (node_id) left join slides using (node_id) left join regions using", "left join utterancesx using (node_id) left join slidesx using (node_id) left join regionsx using"))
def j10_evidence_links(s, d):
    """Evidence of every node, assembled anew from utterances, slides, regions and paper chunks."""
    n = table(s, d, "evidence_links").where("node_id is not null").select("sample_id", "node_id", "content")
    got = E.linked_nodes(n, table(s, d, "utterances"), alignment(s, d), table(s, d, "paper_chunks"))
    return got.select("node_id", *(F.array_join(c, "|").alias(c) for c in ("utterances", "slides", "regions", "chunks")))


@query()
def c08_claim_windows(s, d):
    """Each claim with its related nodes and the chunks of its evidence, as lists."""
    rel = j11_related_nodes(s, d)
    ev = E.claim_evidence(rel, table(s, d, "evidence_links")).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]), "|").alias("chunks"))
    nodes = rel.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "rk", "node_id"))), lambda x: x["node_id"]), "|").alias("nodes"))
    return nodes.join(ev, "claim_id", "left").select("claim_id", "nodes", F.coalesce("chunks", F.lit("")).alias("chunks"))
