"""Queries over time and text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import text as X
from talkgraph.operators import timeline as L

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


def utterances(s, d) -> DataFrame:
    return table(s, d, "utterances").where("start_time is not null and end_time is not null").select("sample_id", "utterance_id", F.col("start_time").alias("us"), F.col("end_time").alias("ue")).distinct()


def prosody(s, d) -> DataFrame:
    p = table(s, d, "evidence_links").select("sample_id", F.explode("prosody_events").alias("p"))
    return p.where("p.event_id is not null and p.start_time is not null and p.end_time is not null").groupBy("sample_id", F.col("p.event_id").alias("event_id")).agg(F.min("p.start_time").alias("s"), F.min("p.end_time").alias("e"))


_U = "u as (select distinct sample_id, utterance_id, start_time us, end_time ue from utterances where start_time is not null and end_time is not null)"
_P = "p as (select sample_id, x.event_id event_id, min(x.start_time) s, min(x.end_time) e from (select sample_id, unnest(prosody_events) x from evidence_links) where x.event_id is not null and x.start_time is not null and x.end_time is not null group by 1,2)"


@query(f"""with {_U}, s as (select distinct sample_id, slide_id, start_time s, end_time e from slides where start_time is not null),
l as (select *, row_number() over (partition by sample_id order by s desc, slide_id desc, coalesce(e,'inf'::double) desc) = 1 is_last from s),
h as (select u.sample_id, utterance_id, us, slide_id, row_number() over (partition by u.sample_id, utterance_id, us order by s, slide_id) k from u join l on l.sample_id = u.sample_id and s <= us and (e is null or us < e or is_last))
select u.utterance_id, slide_id from u left join (select * from h where k = 1) h on h.sample_id = u.sample_id and h.utterance_id = u.utterance_id and h.us = u.us""")
def j01_slide_alignment(s, d):
    return L.slide_at(utterances(s, d), table(s, d, "slides"), "utterance_id", "us")


@query(f"""with {_U}, {_P},
o as (select p.sample_id, event_id, s, e, us, utterance_id, ue, row_number() over (partition by p.sample_id, event_id order by least(e,ue)-greatest(s,us) desc, us, utterance_id, ue) k from p join u on u.sample_id=p.sample_id and least(e,ue)-greatest(s,us) > 0),
r as (select * from p where not exists (select 1 from o where o.sample_id=p.sample_id and o.event_id=p.event_id)),
n as (select r.sample_id, event_id, s, e, us, utterance_id, ue, row_number() over (partition by r.sample_id, event_id order by abs((us+ue)/2-(s+e)/2), us, utterance_id, ue) k from r join u on u.sample_id=r.sample_id),
a as (select event_id, s, e, us, utterance_id, ue from o where k=1 union all select event_id, s, e, us, utterance_id, ue from n where k=1),
c as (select *, greatest(s,us) s1, least(ue, greatest(e, greatest(s,us)+0.01)) e1 from a)
select event_id, utterance_id, round(case when e1 <= s1 then greatest(0.0, e1-0.01) else s1 end,3) start_time, round(e1,3) end_time from c""")
def j03_event_link(s, d):
    return L.linked_events(prosody(s, d), utterances(s, d))


@query(f"""with {_U}, {_P}, q as (select distinct sample_id, s ps, e pe from p where event_id is not null),
n as (select utterance_id, us, abs(pe-us) g, ps, pe, row_number() over (partition by u.sample_id, utterance_id, us, ue order by abs(pe-us), ps, pe) k from u join q on q.sample_id=u.sample_id)
select utterance_id, round(g,6) gap, ps pause_start, pe pause_end from n where k=1""")
def j04_nearest_pause(s, d):
    return L.nearest_pause(utterances(s, d), prosody(s, d).select("sample_id", F.col("s").alias("ps"), F.col("e").alias("pe")).distinct())


def signal(s, d) -> DataFrame:
    """The events table as a signal per user: seconds and value."""
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_type")


_G = "g as (select user_id::varchar sample_id, event_id, epoch_us(ts)/1e6 t, value, event_type from events)"


@query(f"""with {_G}, c as (select sample_id, event_id span_id, t s, t+3600 e from g where event_type='click')
select span_id, coalesce(avg(g.value),-60.0) mean, count(g.value) n from c left join g on g.sample_id=c.sample_id and s<=t and t<=e and g.value is not null group by c.sample_id, span_id""")
def j05_rms_average(s, d):
    g = signal(s, d)
    spans = g.where("event_type = 'click'").select("sample_id", F.col("event_id").alias("span_id"), F.col("t").alias("s"), (F.col("t") + 3600).alias("e"))
    return L.range_average(spans, g.where("value is not null").select("sample_id", "t", F.col("value").alias("v")))


@query(f"""with {_U}, w as (select distinct sample_id, utterance_id || '#' || i pid, w.start t from (select sample_id, utterance_id, unnest(word_timestamps) w, generate_subscripts(word_timestamps,1) i from utterances) where w.start is not null),
h as (select pid, t, utterance_id, row_number() over (partition by pid, t order by us, utterance_id) k from w join u on u.sample_id=w.sample_id and us <= t and t <= ue)
select pid, t, utterance_id span_id from h where k=1""")
def j06_word_containment(s, d):
    w = table(s, d, "utterances").select("sample_id", "utterance_id", F.posexplode("word_timestamps").alias("i", "w")).where("w.start is not null")
    pts = w.select("sample_id", F.concat("utterance_id", F.lit("#"), (F.col("i") + 1).cast("string")).alias("pid"), F.col("w.start").alias("t")).distinct()
    return L.containing(pts, utterances(s, d).select("sample_id", F.col("utterance_id").alias("span_id"), F.col("us").alias("s"), F.col("ue").alias("e")))


@query(f"with {_G} select event_id, round(case when count(*) over (partition by sample_id) <= 2 then value else median(value) over (partition by sample_id order by t, event_id rows between 2 preceding and 2 following) end,6) v from g")
def w01_median_filter(s, d):
    return signal(s, d).withColumn("v", F.round(L.median_filter(None, "sample_id", ["t", "event_id"], "value"), 6)).select("event_id", "v")


@query(f"with {_G} select event_id, round(case when count(value) over w <= 1 or stddev_pop(value) over w <= 1e-8 then 0 else (value - avg(value) over w)/stddev_pop(value) over w end,5) z from g window w as (partition by sample_id)")
def w02_zscore(s, d):
    return signal(s, d).select("event_id", F.round(L.z_score("sample_id", "value"), 5).alias("z"))


@query("select slide_id, start_time, lead(start_time) over (partition by sample_id order by start_time, slide_id) next_start from (select distinct sample_id, slide_id, start_time from slides where start_time is not null)")
def w03_lead_interval(s, d):
    sl = table(s, d, "slides").where("start_time is not null").select("sample_id", "slide_id", "start_time").distinct()
    return sl.select("slide_id", "start_time", F.lead("start_time").over(Window.partitionBy("sample_id").orderBy("start_time", "slide_id")).alias("next_start"))


_WD = "wd as (select distinct sample_id, w.start s, w.end e, w.text t from (select sample_id, unnest(word_timestamps) w from utterances) where w.start is not null and w.end is not null and w.text is not null)"


def spoken(s, d) -> DataFrame:
    return table(s, d, "utterances").select("sample_id", F.explode("word_timestamps").alias("w")).where("w.start is not null and w.end is not null and w.text is not null").select("sample_id", F.col("w.start").alias("s"), F.col("w.end").alias("e"), F.col("w.text").alias("text")).distinct()


@query(f"""with {_WD}, n as (select *, case when lag(e) over o is null or s - lag(e) over o > 0.8 or (regexp_matches(lag(t) over o, '[.!?;:]$') and s - lag(e) over o > 0.2) then 1 else 0 end b from wd window o as (partition by sample_id order by s, e, t)),
g as (select *, sum(b) over (partition by sample_id order by s, e, t rows unbounded preceding) grp from n)
select sample_id, grp::bigint grp, count(*) n_words, round(min(s),3) start_time, round(max(e),3) end_time from g group by 1,2""")
def w04_gap_sessions(s, d):
    return L.gap_sessions(spoken(s, d)).groupBy("sample_id", "grp").agg(F.count("*").alias("n_words"), F.round(F.min("s"), 3).alias("start_time"), F.round(F.max("e"), 3).alias("end_time"))


@query()
def w04_utterances_of_words(s, d):
    """The whole rule over each recording, with the cut of utterances grown too long."""
    return L.utterances_of(spoken(s, d)).select("sample_id", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), "n", "text")


@query(f"""with {_P}, dur as (select sample_id, max(end_time) duration from utterances where end_time is not null group by 1 having max(end_time) > 0),
i as (select p.sample_id, coalesce(greatest(0.0, max(e) over (partition by p.sample_id order by s, e rows between unbounded preceding and 1 preceding)),0.0) a, s b from p join dur using (sample_id)
 union all select sample_id, greatest(0.0, coalesce((select max(e) from p where p.sample_id=dur.sample_id),0.0)), duration from dur)
select sample_id, a start_time, b end_time from i where b - a >= 0.15""")
def w05_speech_segments(s, d):
    dur = table(s, d, "utterances").where("end_time is not null").groupBy("sample_id").agg(F.max("end_time").alias("duration"))
    return L.speech_segments(prosody(s, d).select("sample_id", "s", "e"), dur)


@query("select doc_id, len(string_split(x,'|'))::int n_windows from (select doc_id, case when length(text) > 0 then (select string_agg(i::varchar,'|') from range(0, length(text), 400) t(i)) end x from documents) where x is not null")
def w14_char_windows(s, d):
    return table(s, d, "documents").select("doc_id", F.size(X.char_windows(F.col("text"))).alias("n_windows")).where("n_windows > 0")


@query()
def w12_packed_sentences(s, d):
    """Paper chunks' sentences packed into chunks of at most 900 characters."""
    return table(s, d, "paper_chunks").where("text is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.posexplode(X.packed(X.sentences(F.col("text")))).alias("i", "chunk")).select("chunk_id", "i", F.length("chunk").alias("n_chars"))


_ARRAYS = ("paper_chunks", "utterances", "slides", "visual_regions", "prosody_events", "pragmatic_signals")


@query("with a as (" + " union all ".join(f"select node_id, '{c}' part, max(coalesce(len({c}),0)) n from evidence_links where node_id is not null group by 1" for c in _ARRAYS) + """)
select node_id, part, i::int shard, (floor(n*(i+1)/4.0) - floor(n*i/4.0))::int n_items from a, range(4) t(i)""")
def w15_even_shards(s, d):
    """All six arrays of a node's evidence in four slices each; of a node stored twice the longest arrays."""
    rows = table(s, d, "evidence_links").where("node_id is not null").groupBy("node_id").agg(*(F.max_by(c, F.coalesce(F.size(c), F.lit(-1))).alias(c) for c in _ARRAYS))
    kind = lambda c: F.transform(F.coalesce(F.transform(c, lambda x: F.to_json(x)), F.array().cast("array<string>")), lambda x: x)
    each = rows.select("node_id", F.explode(F.array(*(F.struct(F.lit(c).alias("part"), L.even_shards(kind(c), 4).alias("s")) for c in _ARRAYS))).alias("p"))
    return each.select("node_id", "p.part", F.posexplode("p.s").alias("shard", "items")).select("node_id", "part", "shard", F.size("items").alias("n_items"))


@query(f"with {_P} select event_id, case when e - s >= 0.8 then 'PAUSE_LONG' else 'PAUSE' end kind, round(least(1.0, (e - s) / 2.0), 3) intensity from p where e - s >= 0.05")
def pred11_pause_buckets(s, d):
    return L.pause_events(prosody(s, d)).select("event_id", "kind", "intensity")


@query(f"with {_WD} select sample_id, count(*) n from (select distinct sample_id, round(s,2) a, round(e,2) b, regexp_replace(lower(t),'[^a-z0-9]','','g') k from wd) where k <> '' group by 1")
def a30_word_dedup(s, d):
    k = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    return spoken(s, d).select("sample_id", F.round("s", 2).alias("a"), F.round("e", 2).alias("b"), k.alias("k")).where("k <> ''").distinct().groupBy("sample_id").agg(F.count("*").alias("n"))


@query("select chunk_id, case when k = '' then 'empty' else k end content_key from (select distinct chunk_id, left(trim(regexp_replace(lower(coalesce(text,'')),'[^a-z0-9]+','-','g'),'-'),120) k from paper_chunks)")
def f05_content_key(s, d):
    return table(s, d, "paper_chunks").select("chunk_id", X.content_key(F.col("text")).alias("content_key")).distinct()


@query("select node_id, left(md5(concat_ws('|', sample_id, node_type, case when k='' then 'empty' else k end)),12) stable_id from (select distinct node_id, sample_id, node_type, left(trim(regexp_replace(lower(coalesce(content,'')),'[^a-z0-9]+','-','g'),'-'),120) k from evidence_links)")
def f06_node_id(s, d):
    return table(s, d, "evidence_links").select("node_id", X.node_id(F.col("sample_id"), F.col("node_type"), X.content_key(F.col("content"))).alias("stable_id"), "sample_id", "node_type", "content").distinct().select("node_id", "stable_id")


@query("""select doc_id, len(list_filter(string_split(regexp_replace(text,'([.!?])[ \t\n\r\f\v]+','\\1'||chr(1),'g'),chr(1)), lambda x: regexp_replace(x,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g') <> ''))::int n_sentences,
 len(list_filter(string_split(regexp_replace(text,'([.!?])[ \t\n\r\f\v]+','\\1'||chr(1),'g'),chr(1)), lambda x: length(regexp_replace(x,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g')) >= 20))::int n_long from documents where text is not null""")
def f08_sentences(s, d):
    sn = X.sentences(F.col("text"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(sn).alias("n_sentences"), F.size(F.filter(sn, lambda x: F.length(x) >= 20)).alias("n_long"))


_TERMS = "[" + ",".join(f"'{t}'" for t in O.METRIC_TERMS) + "]"


@query(f"select chunk_id, array_to_string(list_sort(list_transform(list_filter({_TERMS}, lambda t: list_contains(regexp_extract_all(lower(text),'[a-z0-9_]+'), t)), lambda t: case when length(t)<=4 then upper(t) else t end)),',') terms from (select distinct chunk_id, text from paper_chunks where text is not null)")
def f09_metric_terms(s, d):
    return table(s, d, "paper_chunks").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", F.array_join(X.metric_terms(F.col("text")), ",").alias("terms"))


def semantic_rows(s, d) -> DataFrame:
    """Cue-classified sentences of the paper chunks: (sample_id, chunk_id, type, content, confidence)."""
    sents = table(s, d, "paper_chunks").where("text is not null").select("sample_id", "chunk_id", "text").distinct().select("sample_id", "chunk_id", F.explode(X.sentences(F.col("text"))).alias("sent")).where(F.length("sent") >= 20)
    low = F.lower("sent")
    cue = lambda k: low.rlike(O.CUES[k][0])
    ours = F.contains(low, F.lit("we ")) | F.contains(low, F.lit("our ")) | F.contains(low, F.lit("propose"))
    kinds = {"Claim": cue("Claim"), "Method": cue("Method") & ours, "Result": cue("Result") & low.rlike("[0-9]"), "Limitation": cue("Limitation")}
    made = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("type"), F.col("sent").alias("content"), F.lit(O.CUES[k][1]).alias("confidence"))) for k, c in kinds.items())))
    metrics = F.transform(X.metric_terms(F.col("sent")), lambda m: F.struct(F.lit("Metric").alias("type"), m.alias("content"), F.lit(O.CUES["Metric"][1]).alias("confidence")))
    return sents.select("sample_id", "chunk_id", F.explode(F.concat(made, metrics)).alias("n")).select("sample_id", "chunk_id", "n.*")


_SENT = "s0 as (select distinct sample_id, chunk_id, text from paper_chunks where text is not null), s1 as (select sample_id, chunk_id, unnest(list_filter(list_transform(string_split(regexp_replace(text,'([.!?])[ \t\n\r\f\v]+','\\1'||chr(1),'g'),chr(1)), lambda x: regexp_replace(x,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g')), lambda x: length(x) >= 20)) sent from s0)"
_ROWS = f"""{_SENT}, rows as (
 select sample_id, chunk_id, 'Claim' t, sent c, 0.78 f from s1 where regexp_matches(lower(sent), '{O.CUES["Claim"][0]}')
 union all select sample_id, chunk_id, 'Method', sent, 0.72 from s1 where regexp_matches(lower(sent), '{O.CUES["Method"][0]}') and (contains(lower(sent),'we ') or contains(lower(sent),'our ') or contains(lower(sent),'propose'))
 union all select sample_id, chunk_id, 'Result', sent, 0.74 from s1 where regexp_matches(lower(sent), '{O.CUES["Result"][0]}') and regexp_matches(sent,'[0-9]')
 union all select sample_id, chunk_id, 'Limitation', sent, 0.62 from s1 where regexp_matches(lower(sent), '{O.CUES["Limitation"][0]}')
 union all select sample_id, chunk_id, 'Metric', unnest(list_transform(list_filter({_TERMS}, lambda t: list_contains(regexp_extract_all(lower(sent),'[a-z0-9_]+'), t)), lambda t: case when length(t)<=4 then upper(t) else t end)), 0.70 from s1)"""


@query(f"with {_ROWS} select t type, count(*) n, count(distinct sample_id) n_sessions from rows group by 1")
def f10_semantic_cues(s, d):
    return semantic_rows(s, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_sessions"))


_KEYC = "left(trim(regexp_replace(lower(c),'[^a-z0-9]+','-','g'),'-'),120)"


@query(f"""with {_ROWS}, g as (select sample_id, t, {_KEYC} k, max(f) f, min(chunk_id) chunk_id, min(c) c from rows group by 1,2,3),
r as (select *, row_number() over (partition by sample_id, t order by f desc, chunk_id, k) rk from g)
select sample_id, t type, k content_key, f::double confidence, left(md5(concat_ws('|',sample_id,t,k)),12) node_id from r where rk <= case t when 'Claim' then 14 when 'Method' then 16 when 'Limitation' then 10 else 20 end""")
def c07_semantic_nodes(s, d):
    g = semantic_rows(s, d).groupBy("sample_id", "type", X.content_key(F.col("content")).alias("content_key")).agg(F.max("confidence").alias("confidence"), F.min("chunk_id").alias("chunk_id"))
    rk = F.row_number().over(Window.partitionBy("sample_id", "type").orderBy(F.desc("confidence"), "chunk_id", "content_key"))
    most = F.lit(20)
    for k, (_, _, n) in O.CUES.items():
        most = F.when(F.col("type") == k, n).otherwise(most)
    return g.withColumn("rk", rk).where(F.col("rk") <= most).select("sample_id", "type", "content_key", "confidence", X.node_id(F.col("sample_id"), F.col("type"), F.col("content_key")).alias("node_id"))


@query(r"""with t as (select chunk_id, trim(regexp_replace(coalesce(text,''),'[ \t\n\r\f\v]+',' ','g')) t from (select distinct chunk_id, text from paper_chunks)),
c as (select *, length(t) n, length(regexp_replace(t,'[^\p{L}\p{N}]','','g')) a, length(regexp_replace(t,'[\p{L}\p{N} ]','','g')) p from t)
select chunk_id, n = 0 or (n >= 120 and a/n < 0.30 and p/n > 0.35) or (n >= 120 and contains(t,'…') and p/n > 0.42) noisy from c""")
def pred06_embedding_noise(s, d):
    return table(s, d, "paper_chunks").select("chunk_id", "text").distinct().select("chunk_id", X.too_noisy(F.col("text")).alias("noisy"))


@query("select relation, count(*) n from (select case " + " ".join(f"when {' or '.join(f'''contains(lower(question), {chr(39)}{c}{chr(39)})''' for c in cues)} then '{r}'" for r, cues in O.QUESTION_CUES) + " else 'supported_by' end relation from gold_test where question is not null) group by 1")
def f30_question_relation(s, d):
    return table(s, d, "gold_test").where("question is not null").select(X.question_relation(F.col("question")).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"""select utterance_id, unnest(list_filter([
 case when contains(x,'<PAUSE') and contains(x,'kind="long"') and regexp_matches(lower(x),'{O.TRANSITION}') and (contains(x,'<STRESS>') or contains(x,'<SLOW_DOWN>')) then 'PIVOT_MARKER' end,
 case when contains(x,'<STRESS>') and regexp_matches(x,'[A-Za-z0-9_]+-[A-Za-z0-9_]+') then 'FOCUS_MARKER' end,
 case when regexp_matches(lower(x),'{O.DEICTIC}') and contains(x,'<PAUSE') then 'DEICTIC_MARKER' end], lambda v: v is not null)) type from (select distinct utterance_id, enriched_text x from utterances where enriched_text is not null)""")
def f25_pragmatic_signals(s, d):
    x = F.col("enriched_text")
    has = lambda v: F.contains(x, F.lit(v))
    kinds = F.array_compact(F.array(
        F.when(has("<PAUSE") & has('kind="long"') & F.lower(x).rlike(O.TRANSITION) & (has("<STRESS>") | has("<SLOW_DOWN>")), "PIVOT_MARKER"),
        F.when(has("<STRESS>") & x.rlike(r"[A-Za-z0-9_]+-[A-Za-z0-9_]+"), "FOCUS_MARKER"),
        F.when(F.lower(x).rlike(O.DEICTIC) & has("<PAUSE"), "DEICTIC_MARKER"),
    ))
    return table(s, d, "utterances").where("enriched_text is not null").select("utterance_id", "enriched_text").distinct().select("utterance_id", F.explode(kinds).alias("type"))
