"""Smaller operators: lookups, unions, keys, parsing, tags and run figures, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import provenance as P
from talkgraph.functions import text as X
from talkgraph.operators import timeline as L
from talkgraph.operators import triples as T
from talkgraph.plans.timeline import prosody, table, utterances

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_U = "u as (select distinct sample_id, utterance_id, start_time us, end_time ue from utterances where start_time is not null and end_time is not null)"
_P = "p as (select sample_id, x.event_id event_id, min(x.start_time) s, min(x.end_time) e from (select sample_id, unnest(prosody_events) x from evidence_links) where x.event_id is not null and x.start_time is not null and x.end_time is not null group by 1,2)"


@query(f"""with {_P}, s as (select distinct sample_id, slide_id, start_time s, end_time e from slides where start_time is not null and trim(slide_id) <> ''),
l as (select *, row_number() over (partition by sample_id order by s desc, slide_id desc, coalesce(e,'inf'::double) desc) = 1 z from s),
h as (select p.sample_id, event_id, slide_id, row_number() over (partition by p.sample_id, event_id order by l.s, slide_id) k from p join l on l.sample_id=p.sample_id and l.s <= p.s and (l.e is null or p.s < l.e or z))
select event_id, slide_id from h where k = 1""")
def j02_slide_at_time(s: SparkSession, d: str) -> DataFrame:
    """The slide on show when a prosody event begins; times without one are left out."""
    return L.slide_at(prosody(s, d), table(s, d, "slides").where("trim(slide_id) <> ''"), "event_id", "s").where("slide_id is not null")


@query("select session, count(*) n from (select distinct array_to_string(string_split(head_id,'/')[1:2],'/') session, head_id, relation, tail_id from kg_triples where head_id is not null and tail_id is not null) group by 1")
def j15_session_triples(s, d):
    return table(s, d, "kg_triples").where("head_id is not null and tail_id is not null").select(F.substring_index("head_id", "/", 2).alias("session"), "head_id", "relation", "tail_id").distinct().groupBy("session").agg(F.count("*").alias("n"))


@query("""with t as (select triple_id, provenance_score sc from kg_triples where lower(trim(tier))='strong'), a as (select triple_id from kg_triples where relation='compares')
select triple_id, sc score from t union all select triple_id, 0.0::double from a where triple_id not in (select triple_id from t)""")
def j18_append_anchors(s, d):
    """Anchor triples join the top set with score 0 unless they are in it."""
    k = table(s, d, "kg_triples")
    top = k.where(F.lower(F.trim("tier")) == "strong").select("triple_id", F.col("provenance_score").alias("score"))
    return top.unionByName(k.where("relation = 'compares'").join(top, "triple_id", "left_anti").select("triple_id", F.lit(0.0).alias("score")))


@query("""with s as (select head_id, relation, tail_id, max(heuristic_score) sc from supervision where head_id is not null and tail_id is not null group by 1,2,3)
select triple_id, round(coalesce(sc,0.5),6) score from kg_triples left join s using (head_id, relation, tail_id)""")
def j21_score_lookup(s, d):
    sc = table(s, d, "supervision").where("head_id is not null and tail_id is not null").groupBy("head_id", "relation", "tail_id").agg(F.max("heuristic_score").alias("sc"))
    return table(s, d, "kg_triples").join(sc, ["head_id", "relation", "tail_id"], "left").select("triple_id", F.round(F.coalesce("sc", F.lit(0.5)), 6).alias("score"))


@query(f"""with {_P}, {_U}, m as (select sample_id, min(us) a, max(ue) b from u group by 1) select event_id, case when a is null then 'no utterance' when s < a or e > b then 'out of bounds' else 'fine' end state from p left join m using (sample_id)""")
def j25_event_bounds(s, d):
    m = utterances(s, d).groupBy("sample_id").agg(F.min("us").alias("a"), F.max("ue").alias("b"))
    return prosody(s, d).join(m, "sample_id", "left").select("event_id", F.when(F.col("a").isNull(), "no utterance").when((F.col("s") < F.col("a")) | (F.col("e") > F.col("b")), "out of bounds").otherwise("fine").alias("state"))


@query("""with deg as (select n, count(*) c from (select head_id n from kg_triples union all select tail_id from kg_triples) where n is not null group by 1), top as (select n from deg order by c desc, n limit 20),
l as (select distinct head_content || ' --[' || relation || ']--> ' || tail_content line from kg_triples where (head_id in (select n from top) or tail_id in (select n from top)) and head_content is not null and tail_content is not null)
select line from l order by line limit 50""")
def j31_relations_of_top_entities(s, d):
    """Lines of the relations at the 20 busiest nodes, 50 at most: both limits are the operator's."""
    k = table(s, d, "kg_triples")
    top = k.select(F.explode(F.array("head_id", "tail_id")).alias("n")).where("n is not null").groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(20)
    by = lambda c: k.join(F.broadcast(top.select(F.col("n").alias(c))), c, "left_semi").select("head_content", "relation", "tail_content")
    lines = by("head_id").union(by("tail_id")).where("head_content is not null and tail_content is not null")
    return lines.select(F.concat("head_content", F.lit(" --["), "relation", F.lit("]--> "), "tail_content").alias("line")).distinct().orderBy("line").limit(50)


@query("""with c as (select distinct sample_id, chunk_id, page from paper_chunks where page is not null), r as (select distinct sample_id, region_id, try_cast(regexp_extract(slide_id,'([0-9]+)$',1) as int) page from visual_regions)
select chunk_id, region_id, rk from (select chunk_id, region_id, row_number() over (partition by chunk_id order by region_id) rk from c join r using (sample_id, page)) where rk <= 2""")
def j33_page_regions(s, d):
    c = table(s, d, "paper_chunks").where("page is not null").select("sample_id", "chunk_id", "page").distinct()
    r = table(s, d, "visual_regions").select("sample_id", "region_id", F.regexp_extract("slide_id", "([0-9]+)$", 1).try_cast("int").alias("page")).distinct()
    w = Window.partitionBy("chunk_id").orderBy("region_id")
    return c.join(r, ["sample_id", "page"]).withColumn("rk", F.row_number().over(w)).where("rk <= 2").select("chunk_id", "region_id", "rk")


@query("""with q as (select sample_id, count(*) filter (where relation in ('supported_by','measured_by','compares','referenced_by')) >= 3 and count(*) filter (where relation in ('supported_by','measured_by')) >= 1 ok, count(*) n from kg_triples group by 1)
select count(*) sessions, count(*) filter (where ok) succeeded, sum(n)::bigint triples, round(count(*) filter (where ok)::double/count(*),4) success_rate, count(*) filter (where ok)::double/count(*) >= 0.9 accepted from q""")
def a15_run_summary(s, d):
    c = T.coverage(table(s, d, "kg_triples")).join(table(s, d, "kg_triples").groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id")
    rate = F.count_if("passed") / F.count("*")
    return c.agg(F.count("*").alias("sessions"), F.count_if("passed").alias("succeeded"), F.sum("n").alias("triples"), F.round(rate, 4).alias("success_rate"), (rate >= 0.9).alias("accepted"))


_KEY = "regexp_replace(lower({0}),'^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$','','g')"


@query(f"select type, count(*) n from (select distinct head_type type, {_KEY.format('head_content')} c from kg_triples where head_content is not null union select distinct tail_type, {_KEY.format('tail_content')} from kg_triples where tail_content is not null) group by 1")
def a32_distinct_entities(s, d):
    k = table(s, d, "kg_triples")
    key = lambda c: F.regexp_replace(F.lower(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    e = k.select(F.col("head_type").alias("type"), key("head_content").alias("c")).union(k.select("tail_type", key("tail_content"))).where("c is not null").distinct()
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""with {_U}, {_P}, t as (select event_id, sample_id, e - s dur from p) select sample_id, event_id, rk from (select *, row_number() over (partition by sample_id order by dur desc, event_id) rk from t) where rk <= 3""")
def w11_tag_quota(s, d):
    """The three longest events of a session."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("dur"), "event_id")
    return prosody(s, d).withColumn("dur", F.col("e") - F.col("s")).withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("sample_id", "event_id", "rk")


@query("select chunk_id, sample_id || '/chunk/' || lpad((row_number() over (partition by sample_id order by chunk_id) - 1)::varchar, 4, '0') new_id from (select distinct sample_id, chunk_id from paper_chunks)")
def w16_sequential_ids(s, d):
    c = table(s, d, "paper_chunks").select("sample_id", "chunk_id").distinct()
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("chunk_id")) - 1
    return c.select("chunk_id", F.concat("sample_id", F.lit("/chunk/"), F.lpad(n.cast("string"), 4, "0")).alias("new_id"))


@query("select vec_id, rk from (select vec_id, row_number() over (order by round(embedding[1]::double,6) desc, vec_id desc) rk from embeddings) where rk <= 10")
def o06_reversed_ties(s, d):
    """Ten best by score, later ids first on a tie: the limit is the operator."""
    e = table(s, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x")).orderBy(F.desc("x"), F.desc("vec_id")).limit(10)
    return e.select("vec_id", F.row_number().over(Window.orderBy(F.desc("x"), F.desc("vec_id"))).alias("rk"))


@query("select sample_key, sample_id || '/' || left(sha1(concat_ws('|', split, sample_id, coalesce(head_id,''), relation, coalesce(tail_id,''), source_type, coalesce(nullif(negative_type,''),'none'))),16) k from supervision")
def f07_sample_key(s, d):
    e = lambda c: F.coalesce(c, F.lit(""))
    return table(s, d, "supervision").select("sample_key", F.concat("sample_id", F.lit("/"), F.substring(F.sha1(F.concat_ws("|", "split", "sample_id", e("head_id"), "relation", e("tail_id"), "source_type", F.coalesce(F.nullif("negative_type", F.lit("")), F.lit("none")))), 1, 16)).alias("k"))


@query("select result_id, case when len(regexp_extract_all(generated_answer,'[01]'))>0 then regexp_extract_all(generated_answer,'[01]')[-1] end digit from results where generated_answer is not null")
def f18_last_binary(s, d):
    return table(s, d, "results").where("generated_answer is not null").select("result_id", X.last_binary(X.without_thinking(F.col("generated_answer"))).alias("digit"))


@query("select doc_id, length(trim(regexp_replace(text,'[ \t\n\r\f\v]+',' ','g')))::int n from documents where text is not null")
def f19_squeezed_length(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(X.squeeze(F.col("text"))).alias("n"))


@query("select split, count(*) n from supervision where coalesce(include_in_loss,false) group by 1")
def pred14_loss_rows(s, d):
    return table(s, d, "supervision").where(F.coalesce("include_in_loss", F.lit(False))).groupBy("split").agg(F.count("*").alias("n"))


@query("select sample_key, coalesce(heuristic_score,0) >= 0.5 keep from supervision")
def pred15_keep_decision(s, d):
    return table(s, d, "supervision").select("sample_key", (F.coalesce("heuristic_score", F.lit(0.0)) >= 0.5).alias("keep"))


@query("select image_file, 'document page image ' || replace(regexp_replace(image_file,'[.](png|jpg)$',''),'_',' ') caption from (select distinct image_file from slides where image_file is not null)")
def b07_pseudo_captions(s, d):
    i = table(s, d, "slides").where("image_file is not null").select("image_file").distinct()
    return i.select("image_file", F.concat(F.lit("document page image "), F.replace(F.regexp_replace("image_file", r"[.](png|jpg)$", ""), F.lit("_"), F.lit(" "))).alias("caption"))


@query("select session_id from (select distinct session_id from gold_test where session_id is not null) where session_id not in (select session_id from results where session_id is not null)")
def b11_sessions_to_index(s, d):
    """Sessions of the question file that have no results yet."""
    return table(s, d, "gold_test").where("session_id is not null").select("session_id").distinct().join(table(s, d, "results").select("session_id"), "session_id", "left_anti")
