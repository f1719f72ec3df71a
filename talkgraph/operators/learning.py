"""Supervision, splits, features and metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.operators import blocks as B
from talkgraph.operators.triples import allowed_pairs


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < 1e-12, 0.0).otherwise(a / b)


def hard_negatives(positives: DataFrame, pool: DataFrame, existing: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """For each positive edge the k tails most like its own that are not its own: of the true tail's type in the
    same session, allowed for the relation, and not an edge already; by Jaccard to the tail and a little to the
    head, ties by a seeded hash.

    positives: edge_id, sample_id, head_id, head_type, head_content, relation, tail_id, tail_type, tail_content;
    pool: sample_id, id, type, content; existing: head_id, relation, tail_id. Every candidate of the session and
    type is scored, as those without a common word fill up, in blocks; only the best of a positive go beyond a task.
    A null tail id excludes no candidate.
    """
    ok = positives.join(F.broadcast(allowed_pairs(positives)), ["head_type", "relation", "tail_type"], "left_semi")
    known = existing.dropDuplicates(["head_id", "relation", "tail_id"])
    # a positive asks for so many more as edges of its head and relation may be among the best
    more = known.groupBy("head_id", "relation").agg(F.count("*").alias("more"))
    left = ok.join(more, ["head_id", "relation"], "left").select(
        "sample_id", "tail_type", F.col("edge_id").alias("lid"), "tail_id", (F.lit(k) + F.coalesce("more", F.lit(0))).cast("int").alias("need"),
        X.token_hashes(F.coalesce("tail_content", F.lit(""))).alias("tt"), X.token_hashes(F.coalesce("head_content", F.lit(""))).alias("ht"),
    )
    right = (
        pool.where("id is not null").select("sample_id", F.col("id").alias("rid"), F.col("type").alias("tail_type"), X.token_hashes(F.coalesce("content", F.lit(""))).alias("ct"), F.md5(F.concat("id", F.lit(f"|{seed}"))).alias("h"))
        .dropDuplicates(["sample_id", "rid", "tail_type"])
    )

    def score(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        s = B.half_up(B.jaccard(a["tt"], b["ct"]) + 0.15 * B.jaccard(a["ht"], b["ct"]), 6)
        return np.where(a["tail_id"].to_numpy(object)[:, None] == b["rid"].to_numpy(object)[None, :], np.nan, s)

    near = B.best(left, right, ["sample_id", "tail_type"], score, tie=["h", "rid"])
    named = near.join(ok.select(F.col("edge_id").alias("lid"), "head_id", "relation"), "lid")
    fresh = named.join(known.withColumnRenamed("tail_id", "rid"), ["head_id", "relation", "rid"], "left_anti")
    w = Window.partitionBy("lid").orderBy("rk")
    return fresh.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(F.col("lid").alias("edge_id"), F.col("rid").alias("neg_tail"), F.col("score").alias("sim"), F.col("k").alias("rk"))


def balanced_weights(edges: DataFrame) -> DataFrame:
    """base weight * n / (relations * edges of the relation); per-relation counts are joined back, one row each."""
    counts = edges.groupBy("relation").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("r"))
    return edges.join(F.broadcast(counts), "relation").join(F.broadcast(total), F.lit(True)).withColumn("weight", F.round(F.coalesce("sample_weight", F.lit(1.0)) * F.col("n") / (F.col("r") * F.col("c")), 6)).drop("c", "n", "r")


def split_ids(ids: DataFrame, id_col: str, train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """train, dev and test by rank of a seeded hash; sizes are rounded down, the rest is test.

    Only distinct session ids are ranked, and hash prefixes give each task its own stretch of the ranking.
    """
    d = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))))
    b = d.withColumn("b", F.substring("h", 1, 2))
    sizes = b.groupBy("b").agg(F.count("*").alias("c"))
    w = Window.orderBy("b")  # 256 rows
    before = sizes.select("b", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    r = b.join(F.broadcast(before), "b").withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", id_col)) + F.col("before"))
    cut1, cut2 = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * dev)
    return r.select(id_col, F.when(F.col("r") <= cut1, "train").when(F.col("r") <= cut2, "dev").otherwise("test").alias("split"))


def binary_label(source_type: Column, base_tier: Column) -> Column:
    st, bt = F.lower(F.trim(source_type)), F.lower(F.trim(F.coalesce(base_tier, F.lit(""))))
    return F.when((st == "repaired") & (bt != ""), bt.isin("strong", "medium").cast("int")).when(st.isin("strong", "medium", "repaired"), 1).otherwise(0)


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step-wise area under precision and recall over distinct scores; 0 if there is one class only.

    Rows are counted per score before they are put in order.
    """
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("tp"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("s"))
    c = g.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w))
    tot = g.agg(F.sum("tp").alias("p"), F.sum("n").alias("all"))
    x = c.join(F.broadcast(tot), F.lit(True))
    ap = F.sum(F.col("tp") / F.col("p") * F.col("ctp") / F.col("cn"))
    return x.where("p > 0 and p < all").agg(F.round(F.coalesce(ap, F.lit(0.0)), 9).alias("average_precision"))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the labels that occur on either side."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = c.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("pos"), F.lit(0).cast("bigint").alias("pred")).union(
        c.select("g", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "n")
    )
    f1 = each.groupBy("label").agg(safe_div(2.0 * F.sum("tp"), F.sum("pos") + F.sum("pred")).alias("f1"))
    return f1.agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.count("*").alias("n_labels"))


def qa_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, refusal, support, retrieval and time over all results without an error, or those of each group; rates of nothing are null."""
    e = "llm_evaluation"
    ok = F.col("error").isNull() | (F.trim("error") == "")
    open_ = F.coalesce(F.col(f"{e}.is_unanswerable"), F.lit(False))
    judged, correct = F.col(f"{e}.is_correct").isNotNull(), F.coalesce(F.col(f"{e}.is_correct"), F.lit(False))
    r = results.select(
        *(by or []), ok.alias("ok"), (ok & ~open_).alias("ans"), (ok & open_).alias("unans"), (ok & ~open_ & judged).alias("ae"), (ok & judged).alias("je"), correct.alias("correct"),
        F.coalesce(F.col(f"{e}.context_supports_answer"), F.lit(False)).alias("ctx"), (ok & open_ & F.col(f"{e}.properly_refused").isNotNull()).alias("ue"), F.coalesce(F.col(f"{e}.properly_refused"), F.lit(False)).alias("refused"),
        F.coalesce(F.col("retrieval_metrics.node_recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("retrieval_metrics.node_f1"), F.lit(0.0)).alias("f1"), F.coalesce("timing", F.lit(0.0)).alias("timing"),
    )
    rate = lambda hit, base: F.round(F.try_divide(F.count_if(F.col(base) & F.col(hit)), F.count_if(F.col(base))), 6)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col(c))), F.lit(0.0)), 6)
    return r.groupBy(*(by or [])).agg(
        F.count("*").alias("total_samples"), F.count_if(~F.col("ok")).alias("error_count"), F.count_if("ans").alias("answerable_count"), F.count_if("unans").alias("unanswerable_count"),
        rate("correct", "ae").alias("answerable_accuracy"), rate("ctx", "ae").alias("context_support_ratio"), rate("refused", "ue").alias("unanswerable_refusal_rate"), rate("correct", "je").alias("overall_accuracy"),
        mean("recall").alias("avg_node_recall"), mean("f1").alias("avg_node_f1"), mean("timing").alias("avg_time"),
    )


def retrieval_f1(gold: Column, got: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) of two id lists, taken as sets."""
    g, r = F.array_distinct(gold), F.array_distinct(got)
    both = F.size(F.array_intersect(g, r))
    p, q = safe_div(both, F.size(r).cast("double")), safe_div(both, F.size(g).cast("double"))
    return p, q, safe_div(2 * p * q, p + q)


def resume(todo: DataFrame, manifest: DataFrame, key: str, retry: tuple[str, ...] = ("failed_coverage",)) -> DataFrame:
    """What is left to do: keys without a finished row; those whose status asks for another run count as left."""
    return todo.join(manifest.where(~F.coalesce(F.col("status"), F.lit("")).isin(*retry)).select(key).distinct(), key, "left_anti")


def merge_manifests(written: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """Written rows win over recovered ones."""
    return written.unionByName(recovered.join(written.select(key).distinct(), key, "left_anti"))


def supervision(triples: DataFrame, links: DataFrame, negatives: int = 3, medium_weight: float = 0.7) -> DataFrame:
    """Training rows of a graph's edges: strong and medium ones as positives, for each up to ``negatives`` hard negatives
    (two at most whose tails are nodes with paper evidence, the rest from all nodes of the session's edges, none twice), and
    weak edges for analysis only, out of the loss.

    triples: triple_id, sample_id, head_*, relation, tail_*, tier, is_repaired; links: evidence_links. Returns edge_id,
    sample_id, the edge, source_type, negative_type, sample_weight, edge_target, include_in_loss.
    """
    low = F.lower(F.trim(F.coalesce("tier", F.lit(""))))
    t = triples.withColumn("t", F.when(low.isin("strong", "medium"), low).otherwise("weak")).withColumn("edge_id", F.col("triple_id").cast("string"))
    edge = ["edge_id", "sample_id", "head_id", "head_type", "head_content", "relation", "tail_id", "tail_type", "tail_content"]
    repaired = F.coalesce("is_repaired", F.lit(False)) & (F.col("t") != "weak")
    row = lambda df, st, neg, w, target, loss: df.select(*edge, st.alias("source_type"), neg.alias("negative_type"), w.alias("sample_weight"), target.alias("edge_target"), loss.alias("include_in_loss"))
    none, strong = F.lit(None).cast("string"), F.col("t") == "strong"
    pos = t.where("t <> 'weak'")
    own = row(pos, F.when(repaired, "repaired").otherwise(F.col("t")), none, F.when(strong, 1.0).otherwise(medium_weight), F.when(strong, 1.0).otherwise(0.7), F.lit(True))
    weak = row(t.where("t = 'weak'"), F.lit("weak"), none, F.lit(0.0), F.lit(0.0), F.lit(False))
    end = lambda e: F.struct(F.col(f"{e}_id").alias("id"), F.col(f"{e}_type").alias("type"), F.col(f"{e}_content").alias("content"))
    latest = lambda df: df.where("id is not null and type is not null").groupBy("sample_id", "id", "type").agg(F.max("content").alias("content"))
    session = latest(t.select("sample_id", F.explode(F.array(end("head"), end("tail"))).alias("n")).select("sample_id", "n.*"))
    paper = latest(links.where("size(paper_chunks) > 0").select("sample_id", F.col("node_id").alias("id"), F.col("node_type").alias("type"), "content"))
    known = t.where("head_id is not null and tail_id is not null").select("head_id", "relation", "tail_id")
    ask = pos.where("head_id is not null and tail_id is not null").select(*edge)
    first = hard_negatives(ask, paper, known, min(2, negatives)).select("edge_id", "neg_tail", F.lit("paper_hard").alias("kind"), "rk")
    rest = hard_negatives(ask, session, known, negatives + 2).select("edge_id", "neg_tail", F.lit("session_hard").alias("kind"), (F.col("rk") + 100).alias("rk"))
    w = Window.partitionBy("edge_id").orderBy("rk")
    best = first.union(rest).groupBy("edge_id", "neg_tail").agg(F.min(F.struct("rk", "kind")).alias("k")).select("edge_id", "neg_tail", "k.*").withColumn("n", F.row_number().over(w)).where(F.col("n") <= negatives)
    tails = session.select(F.col("id").alias("neg_tail"), F.col("type").alias("new_type"), F.col("content").alias("new_content")).union(paper.select("id", "type", "content")).groupBy("neg_tail").agg(F.min("new_type").alias("new_type"), F.max("new_content").alias("new_content"))
    made = best.join(ask, "edge_id").join(tails, "neg_tail").withColumns({"edge_id": F.concat("edge_id", F.lit("-"), F.col("n").cast("string")), "tail_id": F.col("neg_tail"), "tail_type": F.col("new_type"), "tail_content": F.col("new_content")})
    return own.union(row(made, F.lit("hard_negative"), F.col("kind"), F.lit(1.0), F.lit(0.0), F.lit(True))).union(weak)
