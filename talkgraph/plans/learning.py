"""Queries of supervision, splits, features, metrics and run management, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.operators import evidence as E
from talkgraph.operators import learning as M
from talkgraph.operators import triples as T

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


_ALLOWED = "(values " + ", ".join(f"('{h}','{r}','{t}')" for h, r, t in O.allowed()) + ") al(h, r, t)"
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0},'')),'[a-z0-9_]+'))"


def _jac(a: str, b: str) -> str:
    return f"len(list_intersect({a},{b}))::double/greatest(1,len(list_distinct(list_concat({a},{b}))))"


@query(f"""with pos as (select sample_key edge_id, sample_id, head_id, head_type, relation, tail_id, tail_type, {_TOK.format('tail_content')} tt, {_TOK.format('head_content')} ht from supervision where coalesce(negative_type,'') = ''),
pool as (select distinct sample_id, node_id cid, node_type, min(content) c from evidence_links where node_id is not null group by 1,2,3),
pl as (select sample_id, cid, node_type, {_TOK.format('c')} ct from pool),
pr as (select edge_id, cid, round({_jac('tt','ct')} + 0.15*{_jac('ht','ct')},6) sim, md5(cid || '|42') h from pos join pl on pl.sample_id=pos.sample_id and pl.node_type=pos.tail_type and cid <> tail_id
  semi join {_ALLOWED} on h = head_type and r = relation and t = tail_type where not exists (select 1 from kg_triples k where k.head_id=pos.head_id and k.relation=pos.relation and k.tail_id=pl.cid))
select edge_id, cid neg_tail, sim, rk from (select *, row_number() over (partition by edge_id order by sim desc, h, cid) rk from pr) where rk <= 2""")
def j22_hard_negatives(s, d):
    pos = table(s, d, "supervision").where("coalesce(negative_type, '') = ''").withColumnRenamed("sample_key", "edge_id").select("edge_id", "sample_id", "head_id", "head_type", "head_content", "relation", "tail_id", "tail_type", "tail_content")
    pool = table(s, d, "evidence_links").where("node_id is not null").groupBy("sample_id", F.col("node_id").alias("id"), F.col("node_type").alias("type")).agg(F.min("content").alias("content"))
    return M.hard_negatives(pos, pool, table(s, d, "kg_triples").select("head_id", "relation", "tail_id").where("head_id is not null and tail_id is not null"))


@query("""with c as (select relation, count(*) c from supervision group by 1), t as (select sum(c)::bigint n, count(*) r from c)
select sample_key, round(coalesce(sample_weight,1.0)*n/(r*c),6) weight from supervision join c using (relation), t""")
def a23_balanced_weights(s, d):
    return M.balanced_weights(table(s, d, "supervision").select("sample_key", "relation", "sample_weight")).select("sample_key", "weight")


@query("select split, source_type, count(*) n, count(distinct sample_id) n_sessions from supervision group by all")
def a25_supervision_stats(s, d):
    return table(s, d, "supervision").groupBy("split", "source_type").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_sessions"))


_LAB = "lb as (select round(heuristic_score,6) s, (tier_label >= 1)::int y, tier_label t, case lower(trim(heuristic_tier)) when 'strong' then 2 when 'medium' then 1 else 0 end g from supervision where heuristic_score is not null and tier_label is not null)"


def labels(s, d) -> DataFrame:
    ht = F.lower(F.trim("heuristic_tier"))
    return table(s, d, "supervision").where("heuristic_score is not null and tier_label is not null").select(F.round("heuristic_score", 6).alias("s"), (F.col("tier_label") >= 1).cast("int").alias("y"), F.col("tier_label").alias("t"), F.when(ht == "strong", 2).when(ht == "medium", 1).otherwise(0).alias("g"))


@query(f"""with {_LAB}, g as (select s, sum(y) tp, count(*) n from lb group by 1), c as (select *, sum(tp) over (order by s desc) ctp, sum(n) over (order by s desc) cn from g), t as (select sum(tp) p, sum(n) al from g)
select round(coalesce(sum(tp::double/p*ctp::double/cn),0),9) average_precision from c, t where p > 0 and p < al""")
def a19_average_precision(s, d):
    return M.average_precision(labels(s, d), "y", "s")


@query(f"""with {_LAB}, l as (select t x from lb union select g from lb), f as (select x, 2.0::double*count(*) filter (where t=x and g=x)/greatest(1,count(*) filter (where t=x)+count(*) filter (where g=x)) f1 from l, lb group by 1) select round(avg(f1),9) macro_f1, count(*) n_labels from f""")
def a20_macro_f1(s, d):
    return M.macro_f1(labels(s, d), "t", "g")


@query("""with r as (select error is null or trim(error)='' ok, coalesce(llm_evaluation.is_unanswerable,false) u, llm_evaluation.is_correct c, coalesce(llm_evaluation.context_supports_answer,false) x, llm_evaluation.properly_refused f, coalesce(retrieval_metrics.node_recall,0) nr, coalesce(retrieval_metrics.node_f1,0) nf, coalesce(timing,0) tm from results)
select count(*) total_samples, count(*) filter (where not ok) error_count, count(*) filter (where ok and not u) answerable_count, count(*) filter (where ok and u) unanswerable_count,
 round(count(*) filter (where ok and not u and c)::double/nullif(count(*) filter (where ok and not u and c is not null),0),6) answerable_accuracy,
 round(count(*) filter (where ok and not u and c is not null and x)::double/nullif(count(*) filter (where ok and not u and c is not null),0),6) context_support_ratio,
 round(count(*) filter (where ok and u and f)::double/nullif(count(*) filter (where ok and u and f is not null),0),6) unanswerable_refusal_rate,
 round(count(*) filter (where ok and c)::double/nullif(count(*) filter (where ok and c is not null),0),6) overall_accuracy,
 round(coalesce(avg(nr) filter (where ok),0),6) avg_node_recall, round(coalesce(avg(nf) filter (where ok),0),6) avg_node_f1, round(coalesce(avg(tm) filter (where ok),0),6) avg_time from r""")
def a16_qa_summary(s, d):
    return M.qa_summary(table(s, d, "results"))


@query("""with g as (select node_id, list_distinct(list_transform(paper_chunks, lambda x: x.chunk_id)) a from evidence_links where node_id is not null), r as (select head_id node_id, list(distinct tail_id) b from kg_triples where tail_type='PaperChunk' and tail_id is not null and head_id is not null group by 1),
m as (select node_id, list_sort(a)::varchar ka, len(list_filter(a, lambda x: x is not null)) na, len(b) nb, len(list_intersect(a,b)) k from (select distinct node_id, list_sort(list_filter(a, lambda x: x is not null)) a from g) g join r using (node_id))
select node_id, na n_gold, nb n_got, round(case when nb=0 then 0 else k::double/nb end,6) "precision", round(case when na=0 then 0 else k::double/na end,6) "recall", round(case when k=0 then 0 else 2.0*k/(na+nb) end::double,6) f1 from m""")
def j30_retrieval_f1(s, d):
    gold = table(s, d, "evidence_links").where("node_id is not null").select("node_id", F.array_sort(F.array_distinct(F.filter("paper_chunks.chunk_id", lambda x: x.isNotNull()))).alias("a")).distinct()
    got = table(s, d, "kg_triples").where("tail_type = 'PaperChunk' and tail_id is not null and head_id is not null").groupBy(F.col("head_id").alias("node_id")).agg(F.collect_set("tail_id").alias("b"))
    p, r, f = M.retrieval_f1(F.col("a"), F.col("b"))
    return gold.join(got, "node_id").select("node_id", F.size("a").alias("n_gold"), F.size("b").alias("n_got"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query("""with i as (select distinct sample_id from kg_triples where sample_id is not null), r as (select sample_id, row_number() over (order by md5(sample_id||'|42'), sample_id) r, count(*) over () n from i)
select sample_id, case when r <= floor(n*0.7) then 'train' when r <= floor(n*0.7)+floor(n*0.15) then 'dev' else 'test' end split from r""")
def u07_split_ids(s, d):
    return M.split_ids(table(s, d, "kg_triples"), "sample_id")


@query("select sample_id from (select distinct sample_id from slides) order by md5(sample_id||'|7'), sample_id limit 10")
def pred18_sample_sessions(s, d):
    """A seeded sample of ten sessions: the limit is the operator."""
    return table(s, d, "slides").select("sample_id").distinct().orderBy(F.md5(F.concat("sample_id", F.lit("|7"))), "sample_id").limit(10)


@query()
def m05_edge_scores(s, d):
    """A logistic edge scorer trained on the train split's numeric features: score of every edge."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cols = ["audio_repr.count", "audio_repr.quality_max", "visual_repr.count", "visual_repr.quality_max", "paper_repr.count", "paper_repr.quality_max", "paper_repr.similarity_max"]
    x = table(s, d, "supervision").select("sample_key", "split", *(n(c).alias(f"f{i}") for i, c in enumerate(cols)), F.coalesce(F.col("tier_label"), F.lit(0)).cast("double").alias("label"), F.coalesce("sample_weight", F.lit(1.0)).alias("w"))
    x = VectorAssembler(inputCols=[f"f{i}" for i in range(len(cols))], outputCol="features").transform(x)
    model = LogisticRegression(family="multinomial", weightCol="w", maxIter=50, regParam=0.01).fit(x.where("split = 'train'"))
    p = vector_to_array("probability")
    return model.transform(x).select("sample_key", F.round(F.when(F.size(p) >= 3, p[1] + p[2]).otherwise(1 - p[0]), 4).alias("score"), F.col("prediction").cast("int").alias("tier"))


_NODES = f"q as (select distinct node_id, sample_id, {_TOK.format('content')} t from evidence_links where node_id is not null)"


@query(f"""with a as (select distinct chunk_id, sample_id, {_TOK.format('text')} t from paper_chunks where text is not null), {_NODES},
j as (select node_id, chunk_id, round({_jac('q.t','a.t')},6) score from q join a using (sample_id) where len(list_intersect(q.t,a.t)) > 0), g as (select node_id, chunk_id, max(score) score from j group by all)
select node_id, chunk_id, score, rk from (select *, row_number() over (partition by node_id order by score desc, chunk_id) rk from g) where rk <= 3""")
def j08_jaccard_topk(s, d):
    """The three chunks of its session that share most words with a node, for nodes of every type."""
    chunks = table(s, d, "paper_chunks").where("text is not null").select("sample_id", F.col("chunk_id").alias("id"), "text")
    return E.top_by_words(all_nodes(s, d), chunks, "jaccard", 3).select("node_id", F.col("id").alias("chunk_id"), "score", "rk")


@query(f"""with a as (select distinct utterance_id, sample_id, {_TOK.format('text')} t from utterances where text is not null), {_NODES},
j as (select node_id, utterance_id, round(len(list_intersect(q.t,a.t))::double/least(len(q.t),len(a.t)),6) score from q join a using (sample_id) where len(list_intersect(q.t,a.t)) > 0), g as (select node_id, utterance_id, max(score) score from j group by all)
select node_id, utterance_id, score, rk from (select *, row_number() over (partition by node_id order by score desc, utterance_id) rk from g) where rk <= 3""")
def j09_overlap_topn(s, d):
    """The three utterances of its session that overlap most with a node, for nodes of every type."""
    utt = table(s, d, "utterances").where("text is not null").select("sample_id", F.col("utterance_id").alias("id"), "text")
    return E.top_by_words(all_nodes(s, d), utt, "overlap", 3).select("node_id", F.col("id").alias("utterance_id"), "score", "rk")


def all_nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence_links").where("node_id is not null").select("sample_id", "node_id", "content")


@query("select slide_id, region_id, rk from (select slide_id, region_id, row_number() over (partition by slide_id order by case when region_type='full' then 0 else 1 end, region_id) rk from (select distinct slide_id, region_id, region_type from visual_regions where slide_id is not null)) where rk <= 2")
def pred08_region_targets(s, d):
    r = table(s, d, "visual_regions").where("slide_id is not null").select("slide_id", "region_id", "region_type").distinct()
    w = Window.partitionBy("slide_id").orderBy((F.col("region_type") != "full").cast("int"), "region_id")
    return r.withColumn("rk", F.row_number().over(w)).where("rk <= 2").select("slide_id", "region_id", "rk")


@query("""select slide_id, region_id, score, rk from (select *, row_number() over (partition by slide_id order by score desc, region_id) rk from (select distinct slide_id, region_id, case when trim(coalesce(ocr_text,''))<>'' then 2 else 0 end + case when trim(coalesce(visual_summary,''))<>'' then 2 else 0 end + case when trim(coalesce(chart_type,'')) not in ('','none') then 2 else 0 end + case when coalesce(len(entities),0)>0 then 1 else 0 end score from visual_regions where slide_id is not null)) where rk <= 3""")
def j07_region_semantics(s, d):
    full = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 2).otherwise(0)
    sc = full("ocr_text") + full("visual_summary") + F.when(~F.trim(F.coalesce("chart_type", F.lit(""))).isin("", "none"), 2).otherwise(0) + F.when(F.coalesce(F.size("entities"), F.lit(0)) > 0, 1).otherwise(0)
    r = table(s, d, "visual_regions").where("slide_id is not null").select("slide_id", "region_id", sc.alias("score")).distinct()
    return r.withColumn("rk", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("score"), "region_id"))).where("rk <= 3")


@query("""with n as (select id, type, content, w, row_number() over (partition by type, id order by w desc, content) k from (select head_id id, head_type type, head_content "content", written_at w from kg_triples union all select tail_id, tail_type, tail_content, written_at from kg_triples) where id is not null and type is not null)
select type, count(*) n, count(distinct content) n_contents from n where k = 1 group by 1""")
def a28_node_pools(s, d):
    k = table(s, d, "kg_triples")
    both = k.select(F.col("head_id").alias("id"), F.col("head_type").alias("type"), F.col("head_content").alias("content"), F.col("written_at").alias("w")).union(k.select("tail_id", "tail_type", "tail_content", "written_at")).where("id is not null and type is not null")
    latest = both.groupBy("type", "id").agg(F.min_by("content", F.struct((-F.unix_micros(F.col("w").cast("timestamp"))).alias("w"), "content")).alias("content"))
    return latest.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("content").alias("n_contents"))


@query("select user_id, count(*) n_sessions, max(n)::bigint longest from (select user_id, g, count(*) n from (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) g from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 10 hour then 1 else 0 end b from events)) group by 1,2) group by 1")
def x02_session_window(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "10 hours")).agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
