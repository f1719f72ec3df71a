"""Queries of prosody and recordings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.operators import prosody as R
from talkgraph.operators import timeline as L
from talkgraph.plans.timeline import _P, prosody, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def recordings(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances, pauses, loudness); the loudness of a word is told by its length, for want of a signal."""
    t = table(s, d, "utterances")
    u = t.where("start_time is not null and end_time is not null").groupBy("sample_id", "utterance_id").agg(F.min("start_time").alias("s"), F.min("end_time").alias("e"), F.min("text").alias("text"))
    w = t.select("sample_id", F.explode("word_timestamps").alias("w")).where("w.start is not null and w.end is not null").select("sample_id", F.col("w.start").alias("t"), (-10 * (F.col("w.end") - F.col("w.start"))).alias("v")).distinct()
    return u, prosody(s, d).select("sample_id", F.col("s").alias("ps"), F.col("e").alias("pe")).distinct(), w


_TAGS = f"""{_P}, u as (select sample_id, utterance_id, min(start_time) s, min(end_time) e, min(text) t0 from utterances where start_time is not null and end_time is not null group by 1,2),
i as (select *, row_number() over (partition by sample_id order by s, utterance_id) - 1 i from u), ip as (select *, case when trim(coalesce(t0,'')) = '' then 'utterance_' || i else trim(t0) end t from i),
w as (select distinct sample_id, w.start wt, -10*(w.end-w.start) v from (select sample_id, unnest(word_timestamps) w from utterances) where w.start is not null and w.end is not null),
en as (select ip.utterance_id, coalesce(avg(v), -60) m from ip left join w on w.sample_id = ip.sample_id and wt >= s and wt <= e group by 1),
md as (select ip.*, case when count(*) over (partition by sample_id) <= 2 then m else median(m) over (partition by sample_id order by s, utterance_id rows between 2 preceding and 2 following) end m5, e - s len from ip join en using (utterance_id)),
z as (select *, case when count(*) over p <= 1 or stddev_pop(m5) over p <= 1e-8 then 0 else (m5 - avg(m5) over p) / stddev_pop(m5) over p end ze, case when count(*) over p <= 1 or stddev_pop(len) over p <= 1e-8 then 0 else (len - avg(len) over p) / stddev_pop(len) over p end zl from md window p as (partition by sample_id)),
pp as (select distinct sample_id, s ps, e pe from p), np as (select utterance_id, ps, pe from (select utterance_id, ps, pe, row_number() over (partition by utterance_id order by abs(pe - s), ps, pe) k from ip join pp using (sample_id)) where k = 1),
c as (select z.*, pe - ps pd from z left join np using (utterance_id)),
l as (select utterance_id, t, pd, unnest([{{'k':0,'l':case when ze > 1.5 and len >= 0.05 then 'STRESS' end,'sc':ze}},{{'k':1,'l':case when zl > 1.5 then 'SLOW_DOWN' end,'sc':zl}},{{'k':2,'l':case when ends_with(t,'?') and len >= 0.05 then 'RISING_TONE' end,'sc':1.6::double}},
 {{'k':3,'l':case when regexp_matches(lower(t),'{O.DISFLUENCY}') then 'DISFLUENCY' end,'sc':1.9::double}},{{'k':4,'l':case when pd >= 0.8 then 'PAUSE_LONG' when pd >= 0.2 then 'PAUSE' end,'sc':case when pd >= 0.8 then 1.7::double else 1.3::double end}}], recursive := true) from c),
ch as (select * from (select *, row_number() over (partition by utterance_id order by sc desc, k) r from l where l is not null) where r <= 3),
g as (select utterance_id, string_agg(l, ',' order by r) tags from ch group by 1)"""
_MARK = "case when contains(x,'PAUSE_LONG') then '<PAUSE kind=\"long\"/> ' || t when contains(x,'PAUSE') then '<PAUSE/> ' || t else t end"
for _t in R.WRAPPING:
    _MARK = f"case when contains(x,'{_t}') then '<{_t}>' || ({_MARK}) || '</{_t}>' else ({_MARK}) end"


@query(f"with {_TAGS} select utterance_id, x tags, {_MARK} marked from (select ip.utterance_id, t, coalesce(tags,'') x from ip left join g using (utterance_id))")
def c05_prosody_tags(s, d):
    """The three best tags of each utterance and its text marked up with them; lengths of pauses are left out of the marks."""
    t = R.tagged(*recordings(s, d))
    return t.select("utterance_id", F.array_join("tags", ",").alias("tags"), F.regexp_replace("enriched_text", ' dur="[^"]*"', "").alias("marked"))


@query(f"with {_TAGS} select l tag, count(*) n from ch group by 1")
def f23_prosody_tags(s, d):
    """How often each tag is chosen."""
    return R.tagged(*recordings(s, d)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query()
def u04_linked_events(s, d):
    """Selected and raw events together, each linked to its utterance."""
    return R.linked(R.tagged(*recordings(s, d)), prosody(s, d))


@query(f"with {_TAGS} select k rule, count(*) n from l where l is not null group by 1")
def pred12_debounced(s, d):
    """Candidate tags that are long enough, by rule."""
    u = R.scored(*recordings(s, d))
    labels = {"STRESS": 0, "SLOW_DOWN": 1, "RISING_TONE": 2, "DISFLUENCY": 3, "PAUSE": 4, "PAUSE_LONG": 4}
    rule = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return u.select(F.explode(R.candidates(u)).alias("c")).groupBy(rule[F.col("c.label")].alias("rule")).agg(F.count("*").alias("n"))


@query("""with v as (select sample_id, utterance_id, min(text) t, min(end_time - start_time) x from utterances where text is not null and start_time is not null and end_time is not null group by 1,2),
z as (select *, case when count(*) over p <= 1 or stddev_pop(x) over p <= 1e-8 then 0 else (x - avg(x) over p) / stddev_pop(x) over p end z from v window p as (partition by sample_id))
select utterance_id, case when z > 1.5 and not ends_with(rtrim(t),'?') then rtrim(rtrim(t),'.') || '?' else t end asked from z""")
def f24_question_marks(s, d):
    """Utterances that end high (here: long ones, for want of a pitch) become questions."""
    v = table(s, d, "utterances").where("text is not null and start_time is not null and end_time is not null").groupBy("sample_id", "utterance_id").agg(F.min("text").alias("t"), F.min(F.col("end_time") - F.col("start_time")).alias("x"))
    return v.withColumn("z", L.z_score("sample_id", "x")).select("utterance_id", R.asked(F.col("t"), F.col("z")).alias("asked"))


@query(f"""with {_P}, dur as (select sample_id, max(end_time) duration from utterances where end_time is not null group by 1 having max(end_time) > 0),
i as (select p.sample_id, coalesce(greatest(0.0, max(e) over (partition by p.sample_id order by s, e rows between unbounded preceding and 1 preceding)),0.0) a, s b from p join dur using (sample_id)
 union all select sample_id, greatest(0.0, coalesce((select max(e) from p where p.sample_id=dur.sample_id),0.0)), duration from dur)
select sample_id, a start_time, b end_time, 'utterance_' || (row_number() over (partition by sample_id order by a, b) - 1) "text" from i where b - a >= 0.15""")
def c04_unheard_utterances(s, d):
    """Stand-in utterances of each recording's speech segments."""
    dur = table(s, d, "utterances").where("end_time is not null").groupBy("sample_id").agg(F.max("end_time").alias("duration"))
    return R.unheard(L.speech_segments(prosody(s, d).select("sample_id", "s", "e"), dur))


@query("""select utterance_id, count(*) filter (where trim(coalesce(w.text,'')) <> '' and w.end > w.start) n_valid, count(*) filter (where trim(coalesce(w.text,'')) <> '' and w.end > w.start and w.end - w.start <= 1.2) n_short from (select distinct utterance_id, unnest(word_timestamps) w from utterances) group by 1""")
def pred19_word_tokens(s, d):
    """Words with letters and a length, and those of them that aren't too long to begin speech."""
    w = table(s, d, "utterances").select("utterance_id", F.explode("word_timestamps").alias("w")).distinct()
    ok = (F.trim(F.coalesce("w.text", F.lit(""))) != "") & (F.col("w.end") > F.col("w.start"))
    return w.groupBy("utterance_id").agg(F.count_if(ok).alias("n_valid"), F.count_if(ok & (F.col("w.end") - F.col("w.start") <= 1.2)).alias("n_short"))
