"""Vector retrieval, expansion to triples and reranking, for batches of questions.

Questions are the stated query set; they go to the vectors in blocks whose bytes are checked. Every cut is a window over (question, ...), of which Spark keeps only the first
rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import vectors as V

#: Bytes of query vectors sent to every executor at most; more are searched in blocks of as many.
BROADCAST_BYTES = 16 << 20
CHANNEL_WEIGHTS = {"question": 0.3, "baseline_constraint": 0.25, "metric_constraint": 0.25, "experiment_setting": 0.25, "section_constraint": 0.25, "target_unit": 0.15}
CHANNEL_TOP = {"question": 50, "baseline_constraint": 30, "metric_constraint": 30, "experiment_setting": 30, "section_constraint": 30, "target_unit": 20}


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(qid, node_id, score, rk): for each query (qid, qv[, session]) the k vectors (node_id, v[, session]) with
    the highest inner product, ties by node_id; with ``same`` only those with an equal value in that column.

    Without ``same`` every query meets every vector, as the exact search asks for: the queries go to the
    vectors in blocks of bounded size, and each task keeps its k best a query.
    """
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), "node_id")

    def best(q: DataFrame) -> DataFrame:
        hits = vectors.join(q, same) if same else vectors.join(F.broadcast(q), F.lit(True))
        return hits.select("qid", "node_id", F.round(V.dot(F.col("qv"), F.col("v")), 6).alias("score")).withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= k)

    if same:
        return best(queries)
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("qv")), F.lit(1))).first()
    parts = max(1, -(-n * (8 * max(1, width) + 64) // BROADCAST_BYTES))
    out = None
    for i in range(parts):
        one = best(queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i))
        out = one if out is None else out.union(one)
    return out


def global_then_session(queries: DataFrame, vectors: DataFrame, first: int = 1000, k: int = 50) -> DataFrame:
    """The k best of a query's own session among the first best of all sessions. Small sessions may come short; prefilter by session (nearest_vectors with same) to avoid that."""
    hits = nearest_vectors(queries, vectors.select("node_id", "v"), first)
    own = hits.join(queries.select("qid", "session"), "qid").join(vectors.select("node_id", "session"), ["node_id", "session"], "left_semi")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "node_id")
    return own.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("qid", "node_id", "score", "rk")


def centroid_boost(hits: DataFrame, vectors: DataFrame, alpha: float = 0.15) -> DataFrame:
    """Scores raised by the cosine of each hit to the mean vector of its query's hits: score * (1 + alpha * cos)."""
    h = hits.join(vectors.select("node_id", "v"), "node_id")
    mean = (
        h.select("qid", F.posexplode("v").alias("i", "x")).groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    )
    return h.join(mean, "qid").select("qid", "node_id", F.round(F.col("score") * (1 + alpha * V.cosine(F.col("v"), F.col("c"))), 5).alias("score"))


def expand(hits: DataFrame, incident: DataFrame, by: tuple[str, ...] = ("qid",), cap: int = 300) -> DataFrame:
    """Triples at the hit nodes: (by, head_id, relation, tail_id, sim), sim being the better end's score (no hit: 0), the first cap by node rank and key."""
    t = hits.join(incident, "node_id").groupBy(*by, "head_id", "relation", "tail_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("sim"), F.min("rk").alias("first"))
    w = Window.partitionBy(*by).orderBy("first", "head_id", "relation", "tail_id")
    return t.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).drop("pos", "first")


def merge_channels(hits: DataFrame, target: DataFrame, type_bonus: float = 1.2) -> DataFrame:
    """Weighted sum over channels of the best similarity of each (triple, channel), never below 0; raised where the head's type is the question's target."""
    weight = F.lit(0.1)
    for c, w in CHANNEL_WEIGHTS.items():
        weight = F.when(F.col("channel") == c, w).otherwise(weight)
    key = ["qid", "head_id", "relation", "tail_id"]
    best = hits.groupBy(*key, "channel").agg(F.greatest(F.lit(0.0), F.max("sim")).alias("sim"), F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"))
    total = best.groupBy(*key).agg(F.sum(weight * F.col("sim")).alias("score"), F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"))
    return total.join(target, "qid", "left").withColumn("score", F.when(F.col("head_type") == F.col("target_type"), F.col("score") * type_bonus).otherwise(F.col("score"))).drop("target_type")


def hyperedge_scores(scored: DataFrame, modality_bonus: float = 0.1) -> DataFrame:
    """Every triple gets the sum of the scores of its question and head, raised for each further tail type."""
    agg = scored.groupBy("qid", "head_id").agg(F.sum("score").alias("sum"), F.countDistinct("tail_type").alias("types"))
    return scored.drop("score").join(agg, ["qid", "head_id"]).withColumn("score", F.col("sum") * (1 + modality_bonus * (F.col("types") - 1))).drop("sum", "types")


def fused(scored: DataFrame, mode: str, low: float = 0.3, bonus: float = 0.2, blend: float = 0.6, fallback: int = 5) -> DataFrame:
    """Heuristic score and learned score (column mlp, null: 0.5) in one of three ways: blend, bonus or filter.

    filter keeps what the learned score passes, and the first few by heuristic score where nothing passes.
    """
    m = F.coalesce("mlp", F.lit(0.5))
    if mode == "blend":
        return scored.withColumn("score", blend * m + (1 - blend) * F.col("score"))
    if mode == "bonus":
        return scored.withColumn("score", F.col("score") * (1 + bonus * m))
    any_pass = scored.groupBy("qid").agg(F.bool_or(m >= low).alias("any_pass"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "head_id", "relation", "tail_id")
    top = scored.withColumn("rk", F.row_number().over(w)).where((F.col("rk") <= fallback) | (m >= low))
    return top.join(any_pass, "qid").where(F.when(F.col("any_pass"), m >= low).otherwise(F.col("rk") <= fallback)).drop("any_pass", "rk")


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "head_id", "relation", "tail_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def channels(decomposed: DataFrame) -> DataFrame:
    """One row per question and channel: (qid, channel, query, weight, top_k); empty parts make no channel."""
    row = lambda name, q: F.when(F.trim(F.coalesce(q, F.lit(""))) != "", F.struct(F.lit(name).alias("channel"), q.alias("query"), F.lit(CHANNEL_WEIGHTS[name]).alias("weight"), F.lit(CHANNEL_TOP[name]).alias("top_k")))
    cols = [row(c, F.col(c)) for c in CHANNEL_WEIGHTS if c in decomposed.columns]
    return decomposed.select("qid", F.explode(F.array_compact(F.array(*cols))).alias("c")).select("qid", "c.*")


def subgraph_nodes(top: DataFrame, contents: DataFrame) -> DataFrame:
    """Distinct nodes of each question's triples, heads before tails in order of rank: (qid, pos, node_id, type, content)."""
    ends = top.select("qid", "rk", F.posexplode(F.array("head_id", "tail_id")).alias("e", "node_id")).groupBy("qid", "node_id").agg(F.min(F.struct("rk", "e")).alias("o"))
    w = Window.partitionBy("qid").orderBy("o")
    return ends.withColumn("pos", F.row_number().over(w)).join(contents, "node_id", "left").select("qid", "pos", "node_id", "type", "content")


def linearized(top: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each question's subgraph as lines of text: its nodes, then its edges under their heads' numbers."""
    lines = nodes.select("qid", F.lit(0).alias("part"), "pos", F.format_string("[N%d|%s] %s", "pos", F.coalesce("type", F.lit("?")), F.coalesce("content", F.lit(""))).alias("line"))
    n = nodes.select("qid", "node_id", "pos")
    e = (
        top.join(n.withColumnRenamed("node_id", "head_id").withColumnRenamed("pos", "hp"), ["qid", "head_id"]).join(n.withColumnRenamed("node_id", "tail_id").withColumnRenamed("pos", "tp"), ["qid", "tail_id"])
        .select("qid", F.lit(1).alias("part"), F.col("rk").alias("pos"), F.format_string("N%d └[%s]─> N%d", "hp", "relation", "tp").alias("line"))
    )
    return lines.union(e).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
