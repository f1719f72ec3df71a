"""Queries of edge scorers and of the question decomposer, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.functions import text as X
from talkgraph.operators import learning as M
from talkgraph.operators import scoring as S
from talkgraph.operators import triples as T
from talkgraph.plans.graph import _SUMMARY
from talkgraph.plans.timeline import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NUM = [f"coalesce({a}.{b},0)::double" for a, b in S.NUMERIC] + ["coalesce(is_repaired,false)::int::double"]


@query("select sample_key, " + ", ".join(f"{c} f{i}" for i, c in enumerate(_NUM)) + " from supervision")
def m01_numeric_features(s, d):
    return table(s, d, "supervision").select("sample_key", *(c.alias(f"f{i}") for i, c in enumerate(S.numeric())))


def _terms_sql(e: str) -> str:
    return f"""{e}0 as (select sample_key id, split = 'train' fit, regexp_extract_all(lower(trim(coalesce({e}_type,'') || ' ' || coalesce({e}_content,''))),'[a-z0-9_]+') w from supervision),
{e}1 as (select id, fit, unnest(w) term from {e}0 union all select id, fit, unnest(list_transform(range(1,greatest(1,len(w))), lambda i: w[i]||' '||w[i+1])) from {e}0), {e}2 as (select id, fit, term, count(*) tf from {e}1 group by all),
{e}3 as (select term, count(*) df, sum(tf) total from {e}2 where fit group by 1 order by total desc, term limit 5000), {e}4 as (select count(*) filter (where fit) n from {e}0),
{e}5 as (select id, term, tf*(ln((1+n)::double/(1+df))+1) x from {e}2 join {e}3 using (term), {e}4), {e}6 as (select id, '{e}:' || term feature, x/sqrt(sum(x*x) over (partition by id)) v from {e}5)"""


@query(f"""with {_terms_sql('head')}, {_terms_sql('tail')}, rel as (select sample_key id, relation r, [{', '.join(_NUM)}] a from supervision), known as (select distinct relation r from supervision where split = 'train'),
al as (select * from head6 union all select * from tail6 union all select id, 'relation:' || r, 1.0 from rel semi join known using (r) union all select id, 'n:' || i, a[i+1] from rel, range(14) t(i) union all select id, 'x:' || r || ':' || i, a[i+1] from rel semi join known using (r), range(14) t(i))
select id sample_key, feature, round(v,5) "value" from al where v <> 0""")
def m02_sparse_features(s, d):
    """Terms of head and tail, relation, numbers and numbers by relation, fitted on the train split."""
    e = table(s, d, "supervision")
    return S.features(e, e.where("split = 'train'")).select("sample_key", "feature", F.round("value", 5).alias("value"))


@query("""with x as (select *, lower(trim(coalesce(source_type,'weak'))) st, nullif(trim(coalesce(base_tier,'')),'') b, coalesce(heuristic_tier, base_tier) o from supervision),
y as (select *, case when st = 'repaired' then coalesce(b, o) else o end t from x)
select sample_key, case when st='repaired' and b is not null then (lower(b) in ('strong','medium'))::int when st in ('strong','medium','repaired') then 1 else 0 end edge_label, coalesce(tier_label,0) tier_label,
 case when st='hard_negative' then 0 when lower(trim(coalesce(t,'')))='strong' then 2 when lower(trim(coalesce(t,'')))='medium' then 1 else 0 end heuristic_label from y""")
def f14_edge_label(s, d):
    """Binary, tier and heuristic label of each training edge."""
    e = table(s, d, "supervision")
    return e.select("sample_key", M.binary_label(F.col("source_type"), F.col("base_tier")).alias("edge_label"), F.coalesce("tier_label", F.lit(0)).alias("tier_label"), S.heuristic_label(F.col("source_type"), F.col("heuristic_tier"), F.col("base_tier")).alias("heuristic_label"))


def runs(s, d) -> DataFrame:
    """The six metrics of three stand-in scorers (seeds 0 to 2) on the dev split: mixtures of provenance and heuristic score."""
    e = table(s, d, "supervision").where("split = 'dev'").select(
        M.binary_label(F.col("source_type"), F.col("base_tier")).alias("edge"), F.coalesce("tier_label", F.lit(0)).alias("tier"), F.round(F.coalesce("heuristic_score", F.lit(0.0)), 6).alias("hs"),
        S.heuristic_label(F.col("source_type"), F.col("heuristic_tier"), F.col("base_tier")).alias("ht"), F.coalesce("provenance_score", F.lit(0.0)).alias("p"),
    )
    out = None
    for seed in range(3):
        one = e.withColumn("s", F.round(F.col("p") * (1 - seed * 0.1) + F.col("hs") * (seed * 0.1), 4))
        one = one.withColumn("t", F.when(F.col("s") >= O.STRONG_MIN, 2).when(F.col("s") >= O.MEDIUM_MIN, 1).otherwise(0))
        m = S.evaluated(one).withColumn("seed", F.lit(seed))
        out = m if out is None else out.unionByName(m)
    return out


def _ap_sql(name: str, c: str) -> str:
    return f"""{name}0 as (select seed, {c} v, sum(edge) tp, count(*) n from r group by all), {name}1 as (select *, sum(tp) over (partition by seed order by v desc) ctp, sum(n) over (partition by seed order by v desc) cn, sum(tp) over (partition by seed) p, sum(n) over (partition by seed) al from {name}0),
{name} as (select seed, round(coalesce(sum(case when p > 0 and p < al then tp::double/p*ctp::double/cn end),0),9) x from {name}1 group by 1)"""


def _f1_sql(name: str, c: str) -> str:
    return f"""{name}0 as (select distinct seed, l from (select seed, tier l from r union all select seed, {c} from r)), {name}1 as (select a.seed, l, 2.0::double*count(*) filter (where tier=l and {c}=l)/greatest(1,count(*) filter (where tier=l)+count(*) filter (where {c}=l)) f from {name}0 a join r on r.seed=a.seed group by all), {name} as (select seed, round(avg(f),9) x from {name}1 group by 1)"""


_RUNS = f"""b as (select case when lower(trim(source_type))='repaired' and lower(trim(coalesce(base_tier,''))) <> '' then (lower(trim(base_tier)) in ('strong','medium'))::int when lower(trim(source_type)) in ('strong','medium','repaired') then 1 else 0 end edge,
 coalesce(tier_label,0) tier, round(coalesce(heuristic_score,0),6) hs, coalesce(provenance_score,0) p, lower(trim(coalesce(source_type,'weak'))) st, nullif(trim(coalesce(base_tier,'')),'') bt, coalesce(heuristic_tier, base_tier) o from supervision where split='dev'),
r0 as (select seed, edge, tier, hs, round(p*(1-seed*0.1::double)+hs*(seed*0.1::double),4) s, case when st='repaired' then coalesce(bt,o) else o end tn, st from b, range(3) t(seed)),
r as (select *, case when s >= {O.STRONG_MIN} then 2 when s >= {O.MEDIUM_MIN} then 1 else 0 end t, case when st='hard_negative' then 0 when lower(trim(coalesce(tn,'')))='strong' then 2 when lower(trim(coalesce(tn,'')))='medium' then 1 else 0 end ht from r0),
{_ap_sql('la', 's')}, {_ap_sql('ha', 'hs')}, {_f1_sql('lf', 't')}, {_f1_sql('hf', 'ht')},
m as (select la.seed::int seed, la.x learned_ap, ha.x heuristic_ap, lf.x learned_f1, hf.x heuristic_f1, round((la.x-ha.x)/greatest(1e-8,abs(ha.x)),6) ap_gain, round((lf.x-hf.x)/greatest(1e-8,abs(hf.x)),6) f1_gain from la join ha using (seed) join lf using (seed) join hf using (seed))"""
_SUM = f"{_RUNS}, u as (select 'METRIC' metric, 0.0::double v where false " + " ".join(f"union all select '{x}', {x} from m" for x in S.METRICS) + "), sm as (select metric, count(*) n, round(avg(v),6) mean, round(stddev_pop(v),6) sd from u group by 1)"


@query(f"with {_RUNS} select seed, learned_ap, heuristic_ap, learned_f1, heuristic_f1, ap_gain, f1_gain from m")
def a19_scorer_metrics(s, d):
    """The six metrics of each seed."""
    return runs(s, d)


@query(f"with {_SUM} select * from sm")
def a21_seed_summary(s, d):
    return S.seed_summary(runs(s, d))


@query(f"with {_SUM}, g as (select max(mean) filter (where metric='learned_ap') - max(mean) filter (where metric='heuristic_ap') a, max(mean) filter (where metric='learned_f1') - max(mean) filter (where metric='heuristic_f1') b from sm) select round(a,6) edge_margin, round(b,6) tier_margin, a >= -0.005-1e-12 and b >= -0.005-1e-12 passed from g")
def a22_noninferiority(s, d):
    return S.not_inferior(S.seed_summary(runs(s, d)))


@query(f"with {_RUNS} select seed, learned_ap, learned_f1 from m order by round(learned_ap+learned_f1,6) desc, seed limit 1")
def o08_best_seed(s, d):
    return S.best_seed(runs(s, d)).select("seed", "learned_ap", "learned_f1")


@query()
def m03_mlp_scores(s, d):
    """A multilayer perceptron for each of three seeds; the best by the dev split scores every training edge."""
    scored, _, _ = S.trained_scorer(table(s, d, "supervision"))
    return scored.select("sample_key", "split", "sample_id", F.col("s").alias("score"), F.col("t").alias("tier"))


@query()
def m07_rerank_report(s, d):
    """Rows and kept rows of the best perceptron per split and session."""
    return S.rerank_report(m03_mlp_scores(s, d))


@query()
def m08_edge_scores(s, d):
    """The best perceptron's score of every edge of the graph."""
    _, _, fitted = S.trained_scorer(table(s, d, "supervision"))
    kg = table(s, d, "kg_triples")
    return S.scored_edges(kg.withColumn("provenance", F.coalesce("provenance", F.expr("filter(array(provenance[0]), x -> false)"))), fitted)


@query("select sample_key, round((1/(1+exp(-coalesce(heuristic_score,0)))+1/(1+exp(-coalesce(provenance_score,0))))/2,6) score from supervision")
def m04_two_heads(s, d):
    """The mean of the sigmoids of an edge's and a hyperedge's score."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return table(s, d, "supervision").select("sample_key", F.round(S.two_heads(z("heuristic_score"), z("provenance_score")), 6).alias("score"))


_KEPT = "coalesce(heuristic_score,0) >= 0.5"


@query(f"select case when grouping(split)=1 then 'all' else split end split, case when grouping(sample_id)=1 then 'all' else sample_id end sample_id, count(*) n, count(*) filter (where {_KEPT}) n_kept from supervision group by rollup(split, sample_id)")
def k09_rerank_report(s, d):
    """The report that goes with reranked edges, here of the heuristic score."""
    return S.rerank_report(table(s, d, "supervision").select("split", "sample_id", F.coalesce("heuristic_score", F.lit(0.0)).alias("score")))


@query("""with r as (select result_id, coalesce(llm_evaluation.is_unanswerable,false) u, coalesce(llm_evaluation.is_correct,false) c, coalesce(llm_evaluation.properly_refused,false) f from results),
w as (select result_id, count(*) over o done, sum(case when u then f else c end::int) over o g, sum((not u)::int) over o a, sum((not u and c)::int) over o ar, sum(u::int) over o n, sum((u and f)::int) over o nr from r window o as (order by result_id rows unbounded preceding))
select result_id, done, round(g::double/done,6) accuracy, round(ar::double/nullif(a,0),6) answerable_accuracy, round(nr::double/nullif(n,0),6) refusal_rate from w""")
def a17_reevaluation(s, d):
    """Rates after each judged result, and so at the end."""
    return S.running_rates(table(s, d, "results"), "result_id")


@query("""with r as (select result_id % 7 system, error is null or trim(error)='' ok, coalesce(llm_evaluation.is_unanswerable,false) u, llm_evaluation.is_correct c, llm_evaluation.properly_refused f, coalesce(timing,0) tm from results)
select system, count(*) total_samples, count(*) filter (where not ok) error_count, round(count(*) filter (where ok and not u and c)::double/nullif(count(*) filter (where ok and not u and c is not null),0),6) answerable_accuracy,
 round(count(*) filter (where ok and u and f)::double/nullif(count(*) filter (where ok and u and f is not null),0),6) unanswerable_refusal_rate, round(coalesce(avg(tm) filter (where ok),0),6) avg_time from r group by 1""")
def a18_system_summaries(s, d):
    """The summary of each of seven systems (here: by the result's number)."""
    r = table(s, d, "results").withColumn("system", F.col("result_id") % 7)
    return M.qa_summary(r, ["system"]).select("system", "total_samples", "error_count", "answerable_accuracy", "unanswerable_refusal_rate", "avg_time")


_F30 = "case " + " ".join(f"when {' or '.join(f'''contains(lower(question), {chr(39)}{c}{chr(39)})''' for c in cues)} then '{r}'" for r, cues in O.QUESTION_CUES) + " else 'supported_by' end"


@query(f"""with p as (select answer_type is not null v, target_semantic_unit is not distinct from 'Claim' a, target_relation is not distinct from {_F30} b, answer_type is not distinct from 'short' c, source_type k from decomposer_train where question is not null)
select count(*) n, round(avg(v::int),6) json_valid, round(avg((v and a and b and c)::int),6) exact_match, round(avg((v and a)::int),6) target_semantic_unit, round(avg((v and b)::int),6) target_relation, round(avg(v::int),6) modality_requirement, round(avg(v::int),6) reasoning_pattern,
 round(avg((v and c)::int),6) answer_type, round(avg(v::int),6) answerable, round(count(*) filter (where v and k is not null and k = 'paper')::double/greatest(1,count(*) filter (where v and k is not null)),6) constraints, count(*) filter (where v and k is not null) n_constrained from p""")
def a24_decomposer_metrics(s, d):
    """A decomposer by rules against the training references: replies in prose around the JSON, none where no answer type is known."""
    t = table(s, d, "decomposer_train").where("question is not null")
    ref = F.to_json(F.struct("target_semantic_unit", "target_relation", "answer_type", F.struct(F.col("source_type").alias("metric")).alias("constraints")))
    guess = F.to_json(F.struct(F.lit("Claim").alias("target_semantic_unit"), X.question_relation(F.col("question")).alias("target_relation"), F.lit("short").alias("answer_type"), F.struct(F.lit("paper").alias("metric")).alias("constraints")))
    said = F.when(F.col("answer_type").isNull(), "I see no slots here.").otherwise(F.concat(F.lit("Here it is: ```json\n"), guess, F.lit("\n``` as asked.")))
    return S.slot_metrics(t.select(said.alias("prediction"), ref.alias("reference")))


@query("select case when question is null or trim(question)='' then 'Missing question or decomposition' when answer_type is null then 'Missing slots: answer_type' else 'ok' end outcome, count(*) n from decomposer_train group by 1")
def s23_training_messages(s, d):
    """Training lines that are sound, and what the others lack."""
    t = table(s, d, "decomposer_train")
    c = F.struct(F.col("source_type").alias("metric"))
    line = F.to_json(F.struct("question", F.struct(F.coalesce("target_semantic_unit", F.lit("")).alias("target_semantic_unit"), F.coalesce("target_relation", F.lit("")).alias("target_relation"), c.alias("constraints"), F.lit("any").alias("modality_requirement"), F.lit("x").alias("reasoning_pattern"), "answer_type", F.lit(True).alias("answerable")).alias("decomposition")))
    good, bad = S.training_messages(t.select(F.col("qa_id").alias("n"), line.alias("value")), "Decompose the question.")
    return good.select(F.lit("ok").alias("outcome")).union(bad.select("error")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""select sample_id, count(*) filter (where coalesce(tier_ok,false)) positives, count(*) filter (where not tier_ok) weak from (select sample_id, lower(trim(coalesce(tier,''))) in ('strong','medium') tier_ok from kg_triples) group by 1""")
def m09_supervision_counts(s, d):
    """Positive and weak rows that a session's edges give."""
    ok = F.lower(F.trim(F.coalesce("tier", F.lit("")))).isin("strong", "medium")
    return table(s, d, "kg_triples").groupBy("sample_id").agg(F.count_if(ok).alias("positives"), F.count_if(~ok).alias("weak"))


@query()
def m09_supervision_rows(s, d):
    """Training rows of every edge: positives, their hard negatives from paper nodes and session nodes, and weak rows for analysis."""
    kg = table(s, d, "kg_triples").where("sample_id is not null")
    links = table(s, d, "evidence_links").where("node_id is not null")
    return M.supervision(kg, links)


_OF_EDGES = _SUMMARY.replace("sample_key", "triple_id").replace("supervision", "kg_triples").replace(" where provenance is not null", "")


@query(f"select a.*, k.relation, k.head_type, k.tail_type from ({_OF_EDGES}) a join kg_triples k using (triple_id)")
def f32_inference_features(s, d):
    """What a scorer is given of each edge of the graph."""
    kg = table(s, d, "kg_triples")
    return T.modality_summary(kg.withColumn("provenance", F.coalesce("provenance", F.expr("filter(array(provenance[0]), x -> false)"))), ["triple_id", "head_type", "relation", "tail_type"])
