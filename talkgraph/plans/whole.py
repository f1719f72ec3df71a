"""Queries of papers, regions, runs, extraction and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.functions.shared import written
from talkgraph.operators import answers as Q
from talkgraph.operators import evidence as E
from talkgraph.operators import extraction as G
from talkgraph.operators import learning as M
from talkgraph.operators import papers as P
from talkgraph.operators import runs as R
from talkgraph.operators import triples as T
from talkgraph.operators import vision as V
from talkgraph.plans.evidence import alignment, j11_related_nodes, j29_paper_repairs
from talkgraph.plans.speech import recordings
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


# --- papers and regions


def pages(s, d) -> DataFrame:
    """The paper chunks' texts as pages; a page with several texts has all of them, in order of id."""
    c = table(s, d, "paper_chunks").where("page is not null").select("sample_id", "page", "chunk_id", "text").distinct()
    return c.groupBy("sample_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query()
def c02_paper_chunks(s, d):
    """Pages cut into chunks of whole sentences, numbered through the paper."""
    return P.chunks(pages(s, d)).select("chunk_id", "page", F.length("text").alias("n_chars"))


@query()
def c02_paper_floats(s, d):
    """Figures and tables that the chunks speak of."""
    return P.floats(P.chunks(pages(s, d))).select("float_id", "kind", "page")


_PAGES = "pg as (select sample_id, page, coalesce(string_agg(text, chr(10) order by chunk_id), '') t from (select distinct sample_id, page, chunk_id, text from paper_chunks where page is not null) group by 1,2)"


def _box(k: str) -> str:
    r, h, a, b, c, e, w = P.PROPOSALS[k]
    when = {"always": "true", "figure": "fig", "table": "tab", "neither": "not fig and not tab"}[w]
    side = lambda share, n: f"floor({share}::double * {n})::int"
    return f"select sample_id, page, {-r} r, '{k}' region_type, '{h}' hint, {side(a, 800)} x0, {side(b, 1100)} y0, {side(c, 800)} x1, {side(e, 1100)} y1 from pc where {when}"


@query(f"""with {_PAGES}, pc as (select *, contains(lower(t),'figure') or contains(lower(t),'fig.') fig, contains(lower(t),'table') or contains(lower(t),'tab.') tab from pg), al as ({' union all '.join(_box(k) for k in P.PROPOSALS)}),
f as (select * from (select *, row_number() over (partition by sample_id, page, x0, y0, x1, y1 order by r) q from al) where q = 1)
select sample_id, page, n, region_type, hint, x0, y0, x1, y1 from (select *, row_number() over (partition by sample_id, page order by r) n from f) where n <= 4""")
def f22_region_proposals(s, d):
    """The four likeliest regions of each page, by what its text speaks of."""
    return P.region_proposals(pages(s, d).withColumns({"width": F.lit(800), "height": F.lit(1100)}))


@query("""with px as (select vec_id region_id, (i//8)::int r, (i%8)::int c, least(255,greatest(0,floor(embedding[i+1]::double*(vec_id % 5)*40+128)))::int g from embeddings, range(64) t(i)),
l as (select region_id, max(n)::double/sum(n) dom from (select region_id, g, count(*) n from px group by all) group by 1), s as (select region_id, stddev_pop(g) sd, quantile_cont(g, 0.95) - quantile_cont(g, 0.05) dy from px group by 1),
e as (select region_id, count(*) filter (where abs(d) > 24)::double/count(*) ed from (select a.region_id, a.g - b.g d from px a join px b on a.region_id=b.region_id and ((a.r=b.r and a.c=b.c+1) or (a.c=b.c and a.r=b.r+1))) group by 1)
select region_id, case when dom >= 0.985 or (dy < 6 and sd < 2.5) then 'blank' when ed < 0.004 and dy < 18 and sd < 10 then 'low_info' else 'keep' end verdict from l join s using (region_id) join e using (region_id)""")
def pred07_region_prune(s, d):
    """Vectors seen as grey images of 8 by 8: which are blank or of little structure."""
    px = table(s, d, "embeddings").select(F.col("vec_id").alias("region_id"), F.posexplode("embedding").alias("i", "x")).where("i < 64")
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("x").cast("double") * (F.col("region_id") % 5) * 40 + 128))).cast("int")
    return V.worth_a_look(px.select("region_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), grey.alias("grey")))


_STATUS = "case when trim(coalesce(visual_summary,''))='' then 'empty' when regexp_matches(trim(visual_summary),'(?i)\\b(blank|empty|no visible text|no textual content|no visual elements|cannot determine)\\b') then 'template' else 'ok' end"


@query(f"""with r as (select distinct sample_id, region_id, {_STATUS} st from visual_regions where region_id is not null), k as (select sample_id, st, count(*) n from r group by all),
x as (select sample_id, list_sort(list(distinct region_id)) ids from r where st <> 'ok' group by 1)
select k.sample_id, sum(n)::bigint n_regions, coalesce(sum(n) filter (where st='ok'),0)::bigint n_enriched, round(coalesce(sum(n) filter (where st='ok'),0)::double/greatest(1,sum(n)),4) coverage,
 coalesce(string_agg(st || '=' || n, ',' order by st) filter (where st <> 'ok'),'') failures, coalesce(array_to_string(any_value(ids)[1:5],','),'') examples from k left join x using (sample_id) group by 1""")
def a27_visual_report(s, d):
    """Per session: enriched regions, failures by kind and five examples."""
    r = table(s, d, "visual_regions").where("region_id is not null").select("sample_id", "region_id", V.status(F.col("visual_summary")).alias("status")).distinct()
    return V.report(r)


@query("select origin, sample_id, count(*) n, count(slide_id) n_slides, count(page) n_pages from (select distinct 'slide' origin, sample_id, region_id, slide_id, null::int page from visual_regions union all select distinct 'paper', sample_id, chunk_id, null, page from paper_chunks) group by all")
def u03_all_regions(s, d):
    """Regions of slides and of papers as one table."""
    a = table(s, d, "visual_regions").select("sample_id", "region_id", "slide_id").distinct()
    b = table(s, d, "paper_chunks").select("sample_id", F.col("chunk_id").alias("region_id"), "page").distinct()
    return V.all_regions(a, b).groupBy("origin", "sample_id").agg(F.count("*").alias("n"), F.count("slide_id").alias("n_slides"), F.count("page").alias("n_pages"))


_SEM = "sm as (select region_id, max({'s':visual_summary,'c':chart_type}) x from visual_regions where region_id is not null group by 1)"


@query(f"""with {_SEM}, e as (select 'links' t, node_id k, x.region_id from (select node_id, unnest(visual_regions) x from evidence_links) union all select 'triples', triple_id::varchar, p.region_id from (select triple_id, unnest(provenance) p from kg_triples) union all select 'slides', slide_id, unnest(region_ids) from slides)
select t, e.region_id, count(*) n, min(coalesce(x.s,'')) visual_summary, min(coalesce(x.c,'none')) chart_type from e left join sm using (region_id) where e.region_id is not null group by all""")
def j26_semantics_write_back(s, d):
    """What is known of regions written to all three tables that name them."""
    row = lambda df, t: df.select(F.lit(t).alias("t"), "region_id").where("region_id is not null")
    e = row(table(s, d, "evidence_links").select(F.explode("visual_regions.region_id").alias("region_id")), "links")
    e = e.union(row(table(s, d, "kg_triples").select(F.explode("provenance.region_id").alias("region_id")), "triples")).union(row(table(s, d, "slides").select(F.explode("region_ids").alias("region_id")), "slides"))
    per = e.groupBy("t", "region_id").agg(F.count("*").alias("n"))
    sem = table(s, d, "visual_regions").where("region_id is not null").groupBy("region_id").agg(F.max(F.struct("visual_summary", "chart_type")).alias("x")).select("region_id", "x.*", F.lit(None).cast("array<string>").alias("entities"))
    return V.with_semantics(per, sem).select("t", "region_id", "n", "visual_summary", "chart_type")


@query("""with k as (select vec_id, i, case when i = vec_id % 8 then 0 else 1 end m from embeddings, range(8) t(i)), w as (select vec_id, i, m * sum(m) over (partition by vec_id order by i rows unbounded preceding) w from k),
x as (select e.vec_id, d, sum(embedding[i*8+d+1]::double*w)/sum(w) v from embeddings e join w using (vec_id), range(8) u(d) group by all) select vec_id, d::int d, round(v,5) v from x""")
def w17_pooled_states(s, d):
    """Vectors seen as eight token states of eight numbers, one masked, pooled with growing weights."""
    from talkgraph.functions.vectors import pooled

    e = table(s, d, "embeddings")
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("vec_id") % 8, 0.0).otherwise(1.0))
    return e.select("vec_id", F.posexplode(pooled(states, mask)).alias("d", "v")).select("vec_id", "d", F.round("v", 5).alias("v"))


# --- parsing and estimates


@query("""select event_id, case when x is not null and isfinite(x) then x else -1.0 end v from (select event_id, try_cast(trim(coalesce(json_extract_string(props,'$.k'), props)) as double) x from events)""")
def f15_safe_number(s, d):
    """A number where there is one that is finite, -1 elsewhere."""
    x = F.trim(F.coalesce(F.get_json_object("props", "$.k"), F.col("props"))).try_cast("double")
    return table(s, d, "events").select("event_id", F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(-1.0)).alias("v"))


@query("""select triple_id, greatest(1, length('{"h":"' || replace(replace(h,'\\','\\\\'),'"','\\"') || '","r":"' || r || '","t":"' || replace(replace(t,'\\','\\\\'),'"','\\"') || '"}') // 4)::int n_tokens from (select triple_id, replace(replace(replace(coalesce(head_content,''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') h, coalesce(relation,'') r, replace(replace(replace(coalesce(tail_content,''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') t from kg_triples)""".replace("replace(replace(h,'\\','\\\\'),'\"','\\\"')", "replace(h,'\"','\\\"')").replace("replace(replace(t,'\\','\\\\'),'\"','\\\"')", "replace(t,'\"','\\\"')"))
def f16_token_estimate(s, d):
    """A quarter of the characters that an edge takes as JSON."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return table(s, d, "kg_triples").select("triple_id", G.tokens_of(F.struct(e("head_content").alias("h"), e("relation").alias("r"), e("tail_content").alias("t"))).alias("n_tokens"))


@query("""select triple_id, case triple_id % 4 when 3 then null else weight end w, case triple_id % 4 when 3 then null else tier end t from kg_triples where tier is not null and weight is not null and not contains(tier, '"')""")
def f17_json_replies(s, d):
    """JSON found in replies: bare, in a code fence, in prose with a trailing comma; a broken one gives nulls."""
    from talkgraph.operators.scoring import json_in

    k = table(s, d, "kg_triples").where("tier is not null and weight is not null and not contains(tier, '\"')")
    j = F.to_json(F.struct(F.col("weight").alias("w"), F.col("tier").alias("t")))
    n = F.col("triple_id") % 4
    reply = F.when(n == 0, j).when(n == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(n == 2, F.concat(F.lit("As asked: "), F.regexp_replace(j, r"\}$", ",}"), F.lit(" - done."))).otherwise(F.lit("{\"w\": broken"))
    out = k.select("triple_id", json_in(reply).alias("j"))
    return out.select("triple_id", F.get_json_object("j", "$.w").cast("double").alias("w"), F.get_json_object("j", "$.t").alias("t"))


@query("select utterance_id, round(min(a),3) start_time, round(min(b),3) end_time, count(*) n_words, round(min(w.start)+10,3) first_word, round(max(w.end)+10,3) last_word from (select utterance_id, start_time+10 a, end_time+10 b, unnest(word_timestamps) w from (select distinct utterance_id, start_time, end_time, word_timestamps from utterances)) where w.start is not null and w.end is not null group by 1")
def f33_time_shift(s, d):
    """Utterances and their words moved by ten seconds."""
    from talkgraph.operators.audio import shifted

    u = shifted(table(s, d, "utterances").select("utterance_id", "start_time", "end_time", "word_timestamps").distinct(), 10.0)
    w = u.select("utterance_id", "start_time", "end_time", F.explode("word_timestamps").alias("w")).where("w.start is not null and w.end is not null")
    return w.groupBy("utterance_id").agg(F.round(F.min("start_time"), 3).alias("start_time"), F.round(F.min("end_time"), 3).alias("end_time"), F.count("*").alias("n_words"), F.round(F.min("w.start"), 3).alias("first_word"), F.round(F.max("w.end"), 3).alias("last_word"))


# --- texts of sessions and prompts


def bundle(s, d) -> DataFrame:
    """(session_id, paper, transcript, slides): the raw texts of each session; a session without one of them has an empty text."""
    joined = lambda df, key, c, name: df.where(F.trim(F.coalesce(c, F.lit(""))) != "").select("sample_id", key, c).distinct().groupBy(F.col("sample_id").alias("session_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), "\n").alias(name))
    a = joined(table(s, d, "paper_chunks"), "chunk_id", "text", "paper")
    b, c = joined(table(s, d, "utterances"), "utterance_id", "text", "transcript"), joined(table(s, d, "visual_regions"), "region_id", "ocr_text", "slides")
    return a.join(b, "session_id", "full").join(c, "session_id", "full").fillna("", ["paper", "transcript", "slides"])


def _joined_sql(t: str, key: str, c: str, name: str) -> str:
    return f"{name}0 as (select sample_id session_id, string_agg({c}, chr(10) order by {key}, {c}) {name} from (select distinct sample_id, {key}, {c} from {t} where trim(coalesce({c},'')) <> '') group by 1)"


_BUNDLE = f"{_joined_sql('paper_chunks', 'chunk_id', 'text', 'paper')}, {_joined_sql('utterances', 'utterance_id', 'text', 'transcript')}, {_joined_sql('visual_regions', 'region_id', 'ocr_text', 'slides')}, bu as (select session_id, coalesce(paper,'') paper, coalesce(transcript,'') transcript, coalesce(slides,'') slides from paper0 full join transcript0 using (session_id) full join slides0 using (session_id))"


@query(f"with {_BUNDLE} select session_id, length(paper)::int paper, length(transcript)::int transcript, length(slides)::int slides, md5(paper || transcript || slides) digest from bu")
def s24_raw_text(s, d):
    """All raw texts of each session: paper, transcript and slides."""
    return bundle(s, d).select("session_id", *(F.length(c).alias(c) for c in ("paper", "transcript", "slides")), F.md5(F.concat("paper", "transcript", "slides")).alias("digest"))


_PART = lambda t, c: f"case when {c} <> '' then '=== {t} ===' || chr(10) || {c} end"
_CTX = f"concat_ws(chr(10)||chr(10), {_PART('Paper', 'paper')}, {_PART('Transcript', 'transcript')}, {_PART('Slides', 'slides')})"


@query(f"with {_BUNDLE}, c as (select session_id, {_CTX} x from bu), k as (select session_id, case when length(x) > 20000 then x[1:20000] || chr(10)||chr(10)||'[...truncated...]' else x end x from c) select qa_id, length(x)::int n_context, md5(x) digest from gold_test join k using (session_id) where question is not null")
def e16_native_prompts(s, d):
    """The context of a prompt without any retrieval: all raw texts within the budget of 20,000 characters."""
    c = bundle(s, d).select("session_id", P.native_context({"Paper": F.col("paper"), "Transcript": F.col("transcript"), "Slides": F.col("slides")}, 20_000).alias("x"))
    return table(s, d, "gold_test").where("question is not null").join(c, "session_id").select("qa_id", F.length("x").alias("n_context"), F.md5("x").alias("digest"))


def windows(s, d) -> DataFrame:
    """Windows of all raw text of the sessions that questions ask about."""
    asked = table(s, d, "gold_test").select("session_id").distinct()
    piece = lambda part, name, key, c: table(s, d, name).where(F.trim(F.coalesce(c, F.lit(""))) != "").select(F.col("sample_id").alias("session_id"), F.lit(part).alias("part"), F.col(key).alias("key"), F.col(c).alias("text")).distinct()
    parts = piece(0, "paper_chunks", "chunk_id", "text").union(piece(1, "utterances", "utterance_id", "text")).union(piece(2, "visual_regions", "region_id", "ocr_text"))
    return written(Q.raw_windows(Q.laid(parts.join(asked, "session_id", "left_semi"))), "windows")


def asked(s, d) -> DataFrame:
    return table(s, d, "gold_test").where("question is not null").select(F.col("qa_id").alias("qid"), "session_id", "question", "answer", "answerable")


@query()
def c18_nearest_windows(s, d):
    """Without the graph: the ten windows of its session's raw text that are nearest each question."""
    return Q.nearest_windows(asked(s, d), windows(s, d))


@query()
def c17_answers(s, d):
    """Questions answered from their nearest windows by the offline model, and judged."""
    w = windows(s, d)
    got = Q.judged(Q.answered(asked(s, d), Q.context_of(Q.nearest_windows(asked(s, d), w), w)))
    return got.select("qid", "generated_answer", "llm_evaluation.is_correct", "llm_evaluation.properly_refused", "llm_evaluation.is_unanswerable", "error")


@query()
def c22_baseline_summary(s, d):
    """The summary of the windows baseline over all questions."""
    w = windows(s, d)
    return M.qa_summary(Q.judged(Q.answered(asked(s, d), Q.context_of(Q.nearest_windows(asked(s, d), w), w))))


_NORM = "trim(regexp_replace(lower(coalesce({0},'')),'[^\\p{{L}}\\p{{N}}]+',' ','g'))"


@query(f"""with r as (select coalesce(llm_evaluation.is_unanswerable,false) o, {_NORM.format('ground_truth_answer')} g, {_NORM.format('generated_answer')} a, regexp_matches(lower(generated_answer),'\\b(cannot|can''t|unable|not enough|insufficient|no answer|don''t know|not possible)\\b') f from results where generated_answer is not null and (error is null or trim(error) = '')),
x as (select o, case when o then f else g <> '' and contains(a, g) end good from r) select 'offline' judge, count(*) n, round(avg(good::int),6) overall_accuracy, round(avg(good::int) filter (where not o),6) answerable_accuracy, round(avg(good::int) filter (where o),6) refusal_rate from x""")
def c20_reevaluation(s, d):
    """Stored results judged anew by the offline judge."""
    return Q.reevaluated(table(s, d, "results"))[1]


_LINES = "select node_id, content, row_number() over (partition by node_id order by content) k from (select distinct node_id, content from evidence_links where node_id is not null and content is not null)"


@query(f"with l as ({_LINES}), c as (select node_id, string_agg(content, chr(10) order by k) x from l group by 1) select node_id, length('You answer questions about talks and their papers.' || chr(10) || 'Use the evidence; where it says too little, give what it supports.' || chr(10) || 'Evidence:' || chr(10) || x || chr(10) || 'Question: ' || 'What is it?' || chr(10) || 'Answer:')::int plain, length('You answer questions about talks and their papers.' || chr(10) || 'The graph has 1 nodes (Node (1)) and 0 relations.' || chr(10) || x || chr(10) || 'Follow the relations to what the question asks for.' || chr(10) || 'Question: ' || 'What is it?' || chr(10) || 'Answer:')::int graph from c")
def f29_prompts(s, d):
    """Lengths of the plain and the graph-aware prompt over each node's contents."""
    c = table(s, d, "evidence_links").where("node_id is not null and content is not null").select("node_id", "content").distinct().groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("x"))
    q = F.lit("What is it?")
    return c.select("node_id", F.length(Q.plain_prompt(q, F.col("x"))).alias("plain"), F.length(Q.graph_prompt(q, F.col("x"), F.lit(1), F.lit("Node (1)"), F.lit(0))).alias("graph"))


@query()
def f29_hyperedge_context(s, d):
    """Evidence and relations of each node with edges, as lines of text."""
    h = T.incidence(table(s, d, "kg_triples")).groupBy("node_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    size = lambda c: F.max(F.coalesce(F.size(c), F.lit(0)))
    e = table(s, d, "evidence_links").where("node_id is not null").groupBy("node_id").agg(F.max("content").alias("content"), size("paper_chunks").alias("n_chunks"), size("slides").alias("n_slides"), size("visual_regions").alias("n_regions"), size("utterances").alias("n_utterances"))
    x = e.join(h, "node_id")
    return x.select("node_id", Q.hyperedge_context(F.array(F.struct(F.coalesce("content", F.lit("")).alias("content"), "n_chunks", "n_slides", "n_regions", "n_utterances", "relations")), F.array().cast("array<string>")).alias("lines"))


# --- extraction and repairs


def claims(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, related nodes, evidence chunks) of all sessions."""
    links = table(s, d, "evidence_links").where("node_id is not null")
    node = links.groupBy("sample_id", "node_id", "node_type").agg(F.max("content").alias("content"))
    c = node.where("node_type = 'Claim' and sample_id is not null").select("sample_id", F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["id"])
    rel = j11_related_nodes(s, d)
    w = Window.partitionBy("claim_id").orderBy("type", "rk", "node_id")
    named = rel.withColumn("rk", F.row_number().over(w)).join(node.select("node_id", "content").dropDuplicates(["node_id"]), "node_id").select("claim_id", "rk", F.col("node_id").alias("id"), "type", F.coalesce("content", F.lit("")).alias("content"))
    texts = table(s, d, "paper_chunks").where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return c, named, E.claim_evidence(rel, links).join(texts, "chunk_id").select("claim_id", "pos", "chunk_id", "text")


@query()
def c09_payload_shards(s, d):
    """Claim windows cut to a budget of 400 tokens, in shards of chunks."""
    c, rel, ev = claims(s, d)
    x = G.shards(G.windows(c, rel, ev, 12, 12), 400)
    return x.select(F.col("claim.id").alias("claim_id"), "shard", "shards", F.size("chunks").alias("n_chunks"), G.tokens_of(F.struct("claim", "related", "chunks")).alias("n_tokens"))


@query()
def c12_claim_graph(s, d):
    """The graph of all sessions from their claim windows by the offline extraction, in up to three widening rounds."""
    kg, _ = G.graph(*claims(s, d))
    return kg.select("sample_id", "head_id", "relation", "tail_id", "weight", F.size("provenance").alias("n_prov"))


@query()
def x06_extraction_rounds(s, d):
    """How many sessions each widening round asked, and what it found."""
    return G.graph(*claims(s, d))[1]


def repaired(s, d) -> tuple[DataFrame, DataFrame]:
    kg = table(s, d, "kg_triples").withColumn("provenance", F.coalesce("provenance", F.expr("filter(array(provenance[0]), x -> false)")))
    slides = E.slide_repairs(kg, table(s, d, "evidence_links"), alignment(s, d), table(s, d, "visual_regions"))
    return G.scored_and_repaired(kg, slides, j29_paper_repairs(s, d))


@query()
def c11_repaired_triples(s, d):
    """All triples with their repairs, scored and tiered anew."""
    return repaired(s, d)[0].select("triple_id", "provenance_score", "tier", "is_repaired", F.size("provenance").alias("n_prov"), F.coalesce(F.size("repair_trace"), F.lit(0)).alias("n_trace"))


@query()
def a31_repair_stats(s, d):
    """Repairs tried and made per session, by kind."""
    return repaired(s, d)[1]


@query()
def c14_process_sessions(s, d):
    """All sessions from their records to a scored graph: windows, extraction in rounds, repairs of slides and papers, tiers,
    and the quality report of what came of it."""
    kg, _ = G.graph(*claims(s, d))
    links = table(s, d, "evidence_links")
    slides = E.slide_repairs(kg, links, alignment(s, d), table(s, d, "visual_regions"))
    done, _ = G.scored_and_repaired(kg, slides, E.near_chunks(kg, table(s, d, "paper_chunks")))
    return T.quality_report(done, links)


# --- runs


@query("""with u as (select distinct sample_id from kg_triples where sample_id is not null), a as (select distinct sample_id from utterances), d as (select session_id sample_id, case when bool_and(error is not null and trim(error) <> '') then 'failed_coverage' else 'ok' end st from results where session_id is not null group by 1),
r as (select sample_id from u where sample_id in (select sample_id from a) order by md5(sample_id || '|42'), sample_id limit 200) select sample_id from r where sample_id not in (select sample_id from d where st <> 'failed_coverage')""")
def c21_sessions_to_do(s, d):
    """Sessions a run has left: with audio, of a seeded sample of 200, without a finished row; failed ones are run again."""
    audio = table(s, d, "utterances").select("sample_id").distinct()
    failed = F.bool_and(F.col("error").isNotNull() & (F.trim("error") != ""))
    done = table(s, d, "results").where("session_id is not null").groupBy(F.col("session_id").alias("sample_id")).agg(F.when(failed, "failed_coverage").otherwise("ok").alias("status"))
    return R.to_do(table(s, d, "kg_triples").where("sample_id is not null").select("sample_id").distinct(), audio, done, 200)


_SES = "f as (select sample_id, count(*) triples, count(*) filter (where lower(trim(tier)) in ('strong','medium')) triples_trainable from kg_triples where sample_id is not null group by 1), w as (select sample_id, 'file' origin, triples, triples_trainable from f where triples % 3 = 0), r as (select sample_id, 'recovered' origin, triples, triples_trainable from f where triples % 2 = 0), sel as (select distinct sample_id from slides)"


def manifests(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = table(s, d, "kg_triples").where("sample_id is not null").groupBy("sample_id").agg(F.count("*").alias("triples"), F.count_if(F.lower(F.trim("tier")).isin("strong", "medium")).alias("triples_trainable"))
    return f.where("triples % 3 = 0").withColumn("origin", F.lit("file")), f.where("triples % 2 = 0").withColumn("origin", F.lit("recovered")), table(s, d, "slides").select("sample_id").distinct()


@query(f"with {_SES} select * from (select * from w union all select * from r where sample_id not in (select sample_id from w)) where sample_id in (select sample_id from sel)")
def j24_manifest_merge(s, d):
    """Manifest rows of the selected sessions; those of the file win over recovered ones."""
    return R.manifest(*manifests(s, d)).select("sample_id", "origin", "triples", "triples_trainable")


@query(f"with {_SES}, m as (select * from (select * from w union all select * from r where sample_id not in (select sample_id from w)) where sample_id in (select sample_id from sel)), l as (select count(*) failed from sel where sample_id not in (select sample_id from m)) select count(*) succeeded, any_value(failed) failed, 0::bigint failed_coverage, sum(triples)::bigint triples, sum(triples_trainable)::bigint trainable, round(sum(triples)::double/count(*),4) triples_a_session, round(count(*)::double/(count(*)+any_value(failed)),4) success_rate, count(*)::double/(count(*)+any_value(failed)) >= 0.9 accepted from m, l")
def k07_run_summary(s, d):
    """The summary of a run whose sessions without a manifest row failed."""
    m = R.manifest(*manifests(s, d)).withColumn("status", F.lit("ok"))
    return R.summary(m, manifests(s, d)[2].join(m.select("sample_id"), "sample_id", "left_anti"))


@query("select result_id from results where result_id not in (select result_id from results where error is null or trim(error) = '')")
def j23_resume_anti(s, d):
    """Results that a run has to ask again."""
    r = table(s, d, "results").select("result_id", F.when(F.col("error").isNull() | (F.trim("error") == ""), "ok").otherwise("failed").alias("status"))
    return M.resume(r.select("result_id").distinct(), r, "result_id", ("failed",))


@query("select result_id from results where (error is null or trim(error) = '') and generated_answer is not null")
def pred16_resume_filter(s, d):
    """Stored results that count as done."""
    return table(s, d, "results").where("(error is null or trim(error) = '') and generated_answer is not null").select("result_id")


@query("select doc_id, i, (i % 16)::int shard from (select doc_id, row_number() over (order by doc_id) - 1 i from documents)")
def pred17_shards(s, d):
    """Every document's shard by its place in order."""
    return R.numbered(table(s, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "i", R.shard_of(F.col("i"), 16).cast("int").alias("shard"))


@query("""with u as (select sample_id, utterance_id, min(start_time) s, min(end_time) e, max(selected_tags) tags, max(enriched_text) x from utterances where start_time is not null and end_time is not null group by 1,2),
a as (select sample_id, count(*) filter (where len(tags) > 2) tag_quota, (not coalesce(bool_or(regexp_matches(x,'<STRESS>|<PAUSE')),false))::int no_tags from u group by 1),
e0 as (select distinct sample_id, p.event_id, p.start_time s, p.end_time e, u1 uid from (select sample_id, unnest(prosody_events) p, utterances[1].utterance_id u1 from evidence_links) where p.event_id is not null),
e1 as (select sample_id, event_id, min({'s':s,'e':e,'u':uid}) x from e0 group by 1,2), uu as (select utterance_id, min(s) us, min(e) ue from u group by 1),
b as (select sample_id, count(*) filter (where us is null) missing_link, count(*) filter (where us > x.s or x.s > x.e or x.e > ue) bounds from e1 left join uu on uu.utterance_id = x.u group by 1)
select sample_id, coalesce(tag_quota,0) tag_quota, coalesce(no_tags,0)::bigint no_tags, coalesce(missing_link,0) missing_link, coalesce(bounds,0) bounds from a full join b using (sample_id)""")
def c13_record_errors(s, d):
    """Errors of utterances and events per session, by kind."""
    return c13_validation(s, d, True).select("sample_id", "tag_quota", "no_tags", "missing_link", "bounds")


@query()
def c13_validation(s, d, records_only=False):
    """Which sessions' records are sound, and the errors of the others by kind."""
    u = table(s, d, "utterances").where("start_time is not null and end_time is not null").groupBy("sample_id", "utterance_id").agg(F.min("start_time").alias("s"), F.min("end_time").alias("e"), F.max("selected_tags").alias("tags"), F.max("enriched_text").alias("enriched_text"))
    ev = table(s, d, "evidence_links").select("sample_id", F.explode("prosody_events").alias("p"), F.try_element_at("utterances", F.lit(1))["utterance_id"].alias("utterance_id")).where("p.event_id is not null").select("sample_id", F.col("p.event_id").alias("event_id"), F.col("p.start_time").alias("s"), F.col("p.end_time").alias("e"), "utterance_id").groupBy("sample_id", "event_id").agg(F.min(F.struct("s", "e", "utterance_id")).alias("x")).select("sample_id", "event_id", "x.*")
    kg = table(s, d, "kg_triples").where("sample_id is not null")
    if records_only:
        kg = kg.where("false")
    return R.validation(u, ev, kg.select("sample_id"), T.valid(kg).select("sample_id"))
