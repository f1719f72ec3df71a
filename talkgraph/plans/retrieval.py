"""Queries of retrieval and reranking, and their SQL.

The embeddings table holds the nodes (vec_id, session = label); lineitem gives the edges between them; the
questions are the nodes whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgraph.functions import vectors as V
from talkgraph.operators import answers as Q
from talkgraph.operators import blocks as B
from talkgraph.operators import retrieval as R

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RELATIONS = ("supported_by", "compares", "measured_by", "aligned_to_slide", "grounded_in_paper", "emphasizes", "referenced_by")
TYPES = ("Claim", "Method", "Result", "Metric", "PaperChunk")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("label").alias("session"), F.col("embedding").alias("v"))


def questions(s, d) -> DataFrame:
    return vectors(s, d).where("node_id % 100 = 0").select(F.col("node_id").alias("qid"), "session", F.col("v").alias("qv"))


def pick(xs, c):
    return F.element_at(F.array(*(F.lit(x) for x in xs)), (c % len(xs) + 1).cast("int"))


def edges(s, d) -> DataFrame:
    n = F.lit(s.read.parquet(f"{d}/embeddings.parquet").count())
    return s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % n).alias("head_id"), pick(RELATIONS, F.col("l_orderkey")).alias("relation"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % n).alias("tail_id")).distinct()


def incident(s, d) -> DataFrame:
    return edges(s, d).select(F.explode(F.array_distinct(F.array("head_id", "tail_id"))).alias("node_id"), "head_id", "relation", "tail_id")


_DOT = "round(list_dot_product(q.embedding::double[], v.embedding::double[]),6)"
_Q = "q as (select vec_id qid, label session, embedding from embeddings where vec_id % 100 = 0)"


def _pick(xs, c) -> str:
    return "case " + " ".join(f"when ({c}) % {len(xs)} = {i} then '{x}'" for i, x in enumerate(xs)) + " end"


_E = f"""nn as (select count(*) n from embeddings), e as (select distinct l_partkey % n head_id, {_pick(RELATIONS, 'l_orderkey')} relation, (l_suppkey*7+l_linenumber) % n tail_id from lineitem, nn),
inc as (select head_id node_id, * from e union all select tail_id, * from e where tail_id <> head_id)"""
_CHANNELS = tuple((j, c, R.CHANNEL_WEIGHTS[c], R.CHANNEL_TOP[c]) for j, c in enumerate(R.CHANNEL_WEIGHTS))
_QC = "ch(j, channel, w, k) as (values " + ", ".join(f"({j}, '{c}', {w}::double, {k})" for j, c, w, k in _CHANNELS) + "), qc as (select e.vec_id qid, e.label session, channel, w, k, v.embedding from embeddings e, ch, (select count(*) n from embeddings) n join embeddings v on v.vec_id = (e.vec_id + j) % n.n where e.vec_id % 100 = 0)"
_HC = f"hc as (select * from (select qid, channel, w, k, v.vec_id node_id, {_DOT.replace('q.embedding', 'qc.embedding')} score, row_number() over (partition by qid, channel order by {_DOT.replace('q.embedding', 'qc.embedding')} desc, v.vec_id) rk from embeddings v join qc on qc.session = v.label) where rk <= k)"
_HIT = f"hits as (select * from (select qid, v.vec_id node_id, {_DOT} score, row_number() over (partition by qid order by {_DOT} desc, v.vec_id) rk from embeddings v join q on q.session = v.label) where rk <= 10)"


@query(f"with {_Q} select * from (select qid, v.vec_id node_id, {_DOT} score, row_number() over (partition by qid order by {_DOT} desc, v.vec_id) rk from embeddings v, q) where rk <= 20")
def j19_knn(s, d):
    return R.nearest_vectors(questions(s, d).select("qid", "qv"), vectors(s, d).select("node_id", "v"), 20)


@query(f"""with {_Q}, g as (select * from (select qid, q.session, v.label, v.vec_id node_id, {_DOT} score, row_number() over (partition by qid order by {_DOT} desc, v.vec_id) rk from embeddings v, q) where rk <= 200)
select qid, node_id, score, rk from (select qid, node_id, score, row_number() over (partition by qid order by score desc, node_id) rk from g where label = session) where rk <= 10""")
def j19_knn_global_then_filter(s, d):
    return R.global_then_session(questions(s, d), vectors(s, d), 200, 10)


@query(f"with {_Q}, {_HIT} select * from hits")
def j32_knn_session(s, d):
    return R.nearest_vectors(questions(s, d), vectors(s, d), 10, same="session")


@query(f"""with {_Q}, {_HIT}, h as (select h.*, v.embedding::double[] v from hits h join embeddings v on v.vec_id = h.node_id),
m as (select qid, list(x order by i) c from (select qid, i, avg(x) x from (select qid, unnest(v) x, generate_subscripts(v,1) i from h) group by all) group by 1)
select qid, node_id, round(score*(1+0.15*list_cosine_similarity(v,c)),5) score from h join m using (qid)""")
def a14_centroid_boost(s, d):
    return R.centroid_boost(R.nearest_vectors(questions(s, d), vectors(s, d), 10, same="session"), vectors(s, d))


_EXP = f"""{_QC}, {_E}, {_HC}, x as (select * from (select *, row_number() over (partition by qid, channel order by f, head_id, relation, tail_id) pos from (select qid, channel, any_value(w) w, head_id, relation, tail_id, greatest(0, max(score)) sim, min(rk) f from hc join inc using (node_id) group by qid, channel, head_id, relation, tail_id)) where pos <= 300),
x2 as (select x.*, {_pick(TYPES, 'head_id')} head_type, {_pick(TYPES, 'tail_id')} tail_type from x),
ms as (select qid, head_id, relation, tail_id, any_value(head_type) head_type, any_value(tail_type) tail_type, sum(w*sim)*case when any_value(head_type)='Claim' then 1.2 else 1 end score from x2 group by qid, head_id, relation, tail_id),
hy as (select a.qid, head_id, relation, tail_id, round(sm*(1+0.1*(nt-1)),4) score from ms a join (select qid, head_id, sum(score) sm, count(distinct tail_type) nt from ms group by all) b using (qid, head_id))"""


def channel_hits(s, d) -> DataFrame:
    """(qid, channel, node_id, score, rk): the best nodes of a question's session in each of its six channels. The vector of
    channel j stands j nodes after the question's."""
    v = vectors(s, d)
    n = v.count()
    ch = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(c).alias("channel"), F.lit(k).alias("need")) for j, c, _, k in _CHANNELS))).alias("c")
    q = questions(s, d).select("qid", "session", ch).select("qid", "session", "c.*", ((F.col("qid") + F.col("c.j")) % n).alias("node_id")).join(v.select("node_id", F.col("v").alias("qv")), "node_id")
    left = q.select("session", F.concat_ws("|", F.col("qid").cast("string"), "channel").alias("lid"), "qv", "need")
    got = B.best(left, v.withColumnRenamed("node_id", "rid"), ["session"], lambda a, b: B.half_up(B.products(a["qv"], b["v"]), 6))
    return got.select(F.substring_index("lid", "|", 1).cast(dict(v.dtypes)["node_id"]).alias("qid"), F.substring_index("lid", "|", -1).alias("channel"), F.col("rid").alias("node_id"), "score", "rk")


def typed(df: DataFrame) -> DataFrame:
    return df.withColumn("head_type", pick(TYPES, F.col("head_id"))).withColumn("tail_type", pick(TYPES, F.col("tail_id")))


def expanded(s, d) -> DataFrame:
    return R.expand(channel_hits(s, d), incident(s, d), ("qid", "channel"))


def merged(s, d) -> DataFrame:
    return R.merge_channels(typed(expanded(s, d)), questions(s, d).select("qid", F.lit("Claim").alias("target_type")))


@query(f"with {_EXP} select channel, count(*) n, count(distinct qid) n_questions from x group by 1")
def u01_channel_union(s, d):
    """Distinct (question, channel, triple) of all channels."""
    return expanded(s, d).groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("n_questions"))


@query(f"with {_EXP} select qid, channel, head_id, relation, tail_id, sim from x")
def j14_expand_triples(s, d):
    """The first 300 triples at the nodes that each channel of a question has found."""
    return expanded(s, d)


@query(f"with {_EXP} select qid, head_id, relation, tail_id, round(score,4) score from ms")
def a12_channel_merge(s, d):
    """The weighted sum over six channels for every triple."""
    return merged(s, d).select("qid", "head_id", "relation", "tail_id", F.round("score", 4).alias("score"))


@query(f"with {_EXP} select * from (select qid, head_id, relation, tail_id, round(score,5) score, row_number() over (partition by qid order by round(score,5) desc, head_id, relation, tail_id) rk from hy) where rk <= 10")
def q_minslice_rerank_topk(s, d):
    """For each question the ten best triples of its session, with the hyperedge bonus."""
    return R.top_k(R.hyperedge_scores(merged(s, d)).select("qid", "head_id", "relation", "tail_id", F.round("score", 4).alias("score")))


_MLP = "((head_id*31 + tail_id*17) % 100)/100.0::double"


def with_mlp(s, d) -> DataFrame:
    return merged(s, d).withColumn("mlp", (F.col("head_id") * 31 + F.col("tail_id") * 17) % 100 / F.lit(100.0))


@query(f"with {_EXP} select qid, head_id, relation, tail_id, round(0.6*{_MLP}+0.4*score,5) score from ms")
def m10_blend(s, d):
    return R.fused(with_mlp(s, d), "blend").select("qid", "head_id", "relation", "tail_id", F.round("score", 5).alias("score"))


@query(f"with {_EXP} select qid, head_id, relation, tail_id, round(score*(1+0.2*{_MLP}),5) score from ms")
def m10_bonus(s, d):
    return R.fused(with_mlp(s, d), "bonus").select("qid", "head_id", "relation", "tail_id", F.round("score", 5).alias("score"))


@query(f"""with {_EXP}, m as (select *, case when qid % 200 = 0 then {_MLP} * 0.29 else {_MLP} end mlp, row_number() over (partition by qid order by score desc, head_id, relation, tail_id) rk from ms),
a as (select qid, bool_or(mlp >= 0.3) ok from m group by 1) select qid, head_id, relation, tail_id, round(score,5) score from m join a using (qid) where case when ok then mlp >= 0.3 else rk <= 5 end""")
def m10_filter_fallback(s, d):
    x = with_mlp(s, d).withColumn("mlp", F.when(F.col("qid") % 200 == 0, F.col("mlp") * 0.29).otherwise(F.col("mlp")))
    return R.fused(x, "filter").select("qid", "head_id", "relation", "tail_id", F.round("score", 5).alias("score"))


_PARTS = {"question": "question", "baseline_constraint": "case when source_type = 'paper' then target_relation end", "metric_constraint": "answer_type", "experiment_setting": "source_type", "section_constraint": "case when answer_type = 'short' then 'Results' end", "target_unit": "target_semantic_unit"}


@query("select qid, channel, w weight, k top_k from (" + " union all ".join(f"select qa_id qid, '{c}' channel, {R.CHANNEL_WEIGHTS[c]}::double w, {R.CHANNEL_TOP[c]} k, {x} q from decomposer_train" for c, x in _PARTS.items()) + ") where trim(coalesce(q,'')) <> ''")
def pred20_channels(s, d):
    """Six channels a question, those without anything to ask left out."""
    t = s.read.parquet(f"{d}/decomposer_train.parquet").selectExpr("qa_id qid", *(f"{x} `{c}`" for c, x in _PARTS.items()))
    return R.channels(t).select("qid", "channel", "weight", "top_k")


def reranked(s, d) -> DataFrame:
    return q_minslice_rerank_topk(s, d)


_TOP = f"{_EXP}, tp as (select * from (select qid, head_id, relation, tail_id, row_number() over (partition by qid order by round(score,5) desc, head_id, relation, tail_id) rk from hy) where rk <= 10)"
_NODES = f"{_TOP}, en as (select qid, head_id node_id, rk*2 o from tp union all select qid, tail_id, rk*2+1 from tp), nd as (select qid, node_id, row_number() over (partition by qid order by min(o)) pos from en group by qid, node_id)"


def contents(s, d) -> DataFrame:
    pick = F.element_at(F.array(*(F.lit(x) for x in TYPES)), (F.col("node_id") % len(TYPES) + 1).cast("int"))
    return vectors(s, d).select("node_id", pick.alias("type"), F.concat(F.lit("node "), F.col("node_id").cast("string")).alias("content"))


@query(f"with {_NODES} select qid, pos, node_id, {_pick(TYPES, 'node_id')} type, 'node ' || node_id::varchar \"content\" from nd")
def a29_subgraph_nodes(s, d):
    return R.subgraph_nodes(reranked(s, d), contents(s, d))


@query(f"""with {_NODES}, l as (select qid, 0 part, pos, '[N'||pos||'|'||({_pick(TYPES, 'node_id')})||'] node '||node_id line from nd
 union all select t.qid, 1, t.rk, 'N'||h.pos||' └['||t.relation||']─> N'||g.pos from tp t join nd h on h.qid=t.qid and h.node_id=t.head_id join nd g on g.qid=t.qid and g.node_id=t.tail_id)
select qid, string_agg(line, chr(10) order by part, pos) "text" from l group by 1""")
def f28_linearized(s, d):
    top = reranked(s, d)
    return R.linearized(top, R.subgraph_nodes(top, contents(s, d)))


@query("select vec_id node_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])),5) norm from embeddings")
def f27_norms(s, d):
    return vectors(s, d).select("node_id", F.round(V.norm(F.col("v")), 5).alias("norm"))


_SUB = f"{_NODES}, mo as (select vec_id node_id, vec_id % 4 mc from embeddings), sc as (select qid, round(sum(round(score,5))/greatest(1,count(*)),3) score, count(*) n_edges from (select tp.*, hy.score from tp join hy using (qid, head_id, relation, tail_id)) group by 1), ce as (select qid, count(distinct head_id) n_centers from tp join mo on mo.node_id = tp.head_id where mc >= 2 group by 1), nn2 as (select qid, count(*) n_nodes from nd group by 1)"


@query(f"with {_SUB} select qid, n_nodes, n_edges, score, coalesce(n_centers,0) n_centers from sc join nn2 using (qid) left join ce using (qid)")
def a29_subgraphs(s, d):
    """Each question's ten best triples as a graph: nodes, edges, score and centers with several modalities."""
    modalities = vectors(s, d).select("node_id", (F.col("node_id") % 4).alias("modality_count"))
    g = Q.subgraphs(reranked(s, d), contents(s, d), modalities)
    return g.select("qid", F.size("nodes").cast("bigint").alias("n_nodes"), F.size("edges").cast("bigint").alias("n_edges"), F.round("score", 3).alias("score"), F.coalesce(F.size("centers"), F.lit(0)).cast("bigint").alias("n_centers"))


@query(f"""with {_EXP}, m as (select ms.*, {_MLP} mlp from ms), b as (select qid, head_id, relation, tail_id, head_type, tail_type, 0.6*mlp+0.4*score score from m),
h as (select b.qid, head_id, relation, tail_id, round(sm*(1+0.1*(nt-1)),4) score from b join (select qid, head_id, sum(score) sm, count(distinct tail_type) nt from b group by all) z using (qid, head_id))
select * from (select qid, head_id, relation, tail_id, score, row_number() over (partition by qid order by score desc, head_id, relation, tail_id) rk from h) where rk <= 10""")
def c16_rerank(s, d):
    """The whole rerank: channels merged, blended with a learned score, hyperedge bonus, ten best."""
    x = R.hyperedge_scores(R.fused(with_mlp(s, d), "blend"))
    return R.top_k(x.select("qid", "head_id", "relation", "tail_id", F.round("score", 4).alias("score")))
