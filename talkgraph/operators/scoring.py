"""Features, training and evaluation of edge scorers, and of the question decomposer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.operators.learning import average_precision, binary_label, macro_f1, safe_div

#: Numeric features of an edge, in order: (struct, field).
NUMERIC = (
    ("audio_repr", "count"), ("audio_repr", "quality_max"), ("audio_repr", "duration_sum"), ("visual_repr", "count"), ("visual_repr", "quality_max"), ("visual_repr", "has_chart_hint"),
    ("paper_repr", "count"), ("paper_repr", "quality_max"), ("paper_repr", "repaired_count"), ("paper_repr", "similarity_max"), ("modality_mask", "audio"), ("modality_mask", "visual"), ("modality_mask", "paper"),
)
#: Slots of a decomposed question (fixed values).
SLOTS = ("target_semantic_unit", "target_relation", "modality_requirement", "reasoning_pattern", "answer_type", "answerable")


def numeric() -> list[Column]:
    """The 14 numeric features; missing ones are 0."""
    return [F.coalesce(F.col(f"{a}.{b}").cast("double"), F.lit(0.0)) for a, b in NUMERIC] + [F.coalesce("is_repaired", F.lit(False)).cast("double")]


def tier_number(tier: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(tier, F.lit(""))))
    return F.when(low == "strong", 2).when(low == "medium", 1).otherwise(0)


def heuristic_label(source_type: Column, heuristic_tier: Column, base_tier: Column) -> Column:
    """The tier that the rules gave an edge: none for hard negatives, the base tier for repaired ones."""
    st = F.lower(F.trim(F.coalesce(source_type, F.lit("weak"))))
    base = F.nullif(F.trim(F.coalesce(base_tier, F.lit(""))), F.lit(""))
    own = F.coalesce(heuristic_tier, base_tier)
    return F.when(st == "hard_negative", 0).when(st == "repaired", tier_number(F.coalesce(base, own))).otherwise(tier_number(own))


def term_weights(docs: DataFrame, fit: DataFrame, id_col: str, text_col: str, most: int = 5000) -> DataFrame:
    """(id, term, weight): words and pairs of neighbours, of which the ``most`` frequent of the rows to fit are kept,
    idf = ln((1 + n) / (1 + df)) + 1 over these rows, vectors of unit length."""

    def grams(df: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
        base = df.select(id_col, words.alias("w"))
        pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
        return base.select(id_col, F.explode(F.concat("w", pairs)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))

    known = grams(fit).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = known.orderBy(F.desc("total"), "term").limit(most)  # the vocabulary's size is the operator's
    n = fit.select(F.count("*").alias("n"))
    x = grams(docs).join(F.broadcast(kept.select("term", "df")), "term").join(F.broadcast(n), F.lit(True)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = x.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return x.join(length, id_col).select(id_col, "term", (F.col("x") / F.col("len")).alias("weight"))


def features(edges: DataFrame, fit: DataFrame, most: int = 5000) -> DataFrame:
    """(sample_key, feature, value), sparse: terms of head and tail (fitted apart), relation, the numeric features and
    each of them by relation. Features that are 0 are left out; relations that weren't seen to fit have none."""
    said = lambda df, e: df.select("sample_key", F.trim(F.concat(F.coalesce(f"{e}_type", F.lit("")), F.lit(" "), F.coalesce(f"{e}_content", F.lit("")))).alias("t"))
    terms = [term_weights(said(edges, e), said(fit, e), "sample_key", "t", most).select("sample_key", F.concat(F.lit(f"{e}:"), "term").alias("feature"), F.col("weight").alias("value")) for e in ("head", "tail")]
    known = edges.join(F.broadcast(fit.select("relation").distinct()), "relation", "left_semi")
    rel = known.select("sample_key", F.concat(F.lit("relation:"), "relation").alias("feature"), F.lit(1.0).alias("value"))
    values = F.posexplode(F.array(*numeric())).alias("i", "value")
    num = edges.select("sample_key", values).select("sample_key", F.concat(F.lit("n:"), F.col("i").cast("string")).alias("feature"), "value")
    cross = known.select("sample_key", "relation", values).select("sample_key", F.concat(F.lit("x:"), "relation", F.lit(":"), F.col("i").cast("string")).alias("feature"), "value")
    return terms[0].union(terms[1]).union(rel).union(num).union(cross).where("value <> 0")


def evaluated(rows: DataFrame) -> DataFrame:
    """One row of the six metrics of learned and heuristic scores (edge, tier, s, hs, t, ht): areas under precision and
    recall of the edge label, macro F1 of the tiers, and how far the learned ones are better."""
    ap = lambda s, name: average_precision(rows.where(F.col(s).isNotNull()), "edge", s).toDF(name)
    f1 = lambda t, name: macro_f1(rows, "tier", t).select(F.col("macro_f1").alias(name))
    m = ap("s", "learned_ap").crossJoin(ap("hs", "heuristic_ap")).crossJoin(f1("t", "learned_f1")).crossJoin(f1("ht", "heuristic_f1"))  # one row each
    better = lambda a, b: safe_div(F.col(a) - F.col(b), F.greatest(F.lit(1e-8), F.abs(F.col(b))))
    return m.withColumns({"ap_gain": F.round(better("learned_ap", "heuristic_ap"), 6), "f1_gain": F.round(better("learned_f1", "heuristic_f1"), 6)})


METRICS = ("learned_ap", "heuristic_ap", "learned_f1", "heuristic_f1", "ap_gain", "f1_gain")


def seed_summary(runs: DataFrame) -> DataFrame:
    """(metric, n, mean, sd) over seeds of the six metrics; sd is that of a population."""
    long = runs.select("seed", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x")).select("seed", "x.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


def not_inferior(summary: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Whether the learned scorer is no worse than the heuristic one in both metrics, give or take the tolerance."""
    at = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("mean"))), F.lit(0.0))
    m = summary.agg((at("learned_ap") - at("heuristic_ap")).alias("edge_margin"), (at("learned_f1") - at("heuristic_f1")).alias("tier_margin"))
    enough = lambda c: F.col(c) >= -tolerance - 1e-12
    return m.select(F.round("edge_margin", 6).alias("edge_margin"), F.round("tier_margin", 6).alias("tier_margin"), (enough("edge_margin") & enough("tier_margin")).alias("passed"))


def best_seed(runs: DataFrame) -> DataFrame:
    """The seed with the highest sum of the learned area and F1, the lowest on a tie."""
    return runs.orderBy(F.desc(F.round(F.col("learned_ap") + F.col("learned_f1"), 6)), "seed").limit(1)


def json_in(reply: Column) -> Column:
    """The JSON object in a model's reply: the whole of it, what a code fence holds, or from its first to its last brace; null if there is none.

    Null, empty and broken replies give null; trailing commas and single quotes are mended.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(cut, r",\s*([}\]])", "$1"), r"'([^'\"]*)'(\s*[:,}\]])", '"$1"$2')
    ok = lambda c: F.when((c != "") & F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(ok(F.when(bare.startswith("{"), bare)), ok(cut), ok(mended))


def slot_metrics(pairs: DataFrame) -> DataFrame:
    """Per slot accuracy, exact match, constraints and share of valid JSON of predictions against references.

    pairs: prediction (a reply), reference (JSON with the slots and constraints). Slots that both lack agree.
    """
    p = pairs.select(json_in(F.col("prediction")).alias("p"), "reference")
    slot = lambda c, s: F.get_json_object(c, f"$.{s}")
    same = {s: F.col("p").isNotNull() & slot("p", s).eqNullSafe(slot("reference", s)) for s in SLOTS}
    held = lambda c: F.from_json(F.coalesce(F.get_json_object(c, "$.constraints"), F.lit("{}")), "map<string,string>")
    asked = F.map_filter(held("reference"), lambda k, v: v.isNotNull() & (v != "null"))
    met = F.forall(F.map_entries(asked), lambda e: F.try_element_at(held("p"), e["key"]).eqNullSafe(e["value"]))
    has = F.col("p").isNotNull() & (F.size(asked) > 0)
    share = lambda c: F.round(F.count_if(c) / F.greatest(F.lit(1), F.count("*")), 6)
    every = F.lit(True)
    for c in same.values():
        every = every & c
    return p.agg(F.count("*").alias("n"), share(F.col("p").isNotNull()).alias("json_valid"), share(every).alias("exact_match"), *(share(c).alias(s) for s, c in same.items()), F.round(F.count_if(has & met) / F.greatest(F.lit(1), F.count_if(has)), 6).alias("constraints"), F.count_if(has).alias("n_constrained"))


def training_messages(lines: DataFrame, system: str) -> tuple[DataFrame, DataFrame]:
    """(messages, errors) of question and decomposition lines (n, value): lines of sound JSON that have every slot and an
    object of constraints become messages; the others are named with what they lack. Blank lines are skipped."""
    need = ("target_semantic_unit", "target_relation", "constraints", "modality_requirement", "reasoning_pattern", "answer_type", "answerable")
    rows = lines.where(F.trim("value") != "").withColumn("d", F.get_json_object("value", "$.decomposition")).withColumn("q", F.get_json_object("value", "$.question"))
    keys = F.coalesce(F.json_object_keys("d"), F.array().cast("array<string>"))
    lack = F.array_except(F.array(*(F.lit(s) for s in need)), keys)
    error = (
        F.when(F.get_json_object("value", "$").isNull(), "JSON parse error").when(F.coalesce("q", F.lit("")).isin("") | F.col("d").isNull() | F.coalesce(F.col("d"), F.lit("")).isin("", "{}"), "Missing question or decomposition")
        .when(F.size(lack) > 0, F.concat(F.lit("Missing slots: "), F.array_join(lack, ", "))).when(~F.coalesce(F.get_json_object("d", "$.constraints"), F.lit("")).startswith("{"), "constraints must be an object")
    )
    rows = rows.withColumn("error", error)
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    good = rows.where("error is null").select("n", F.coalesce(F.get_json_object("value", "$.sample_id"), F.lit("")).alias("sample_id"), F.array(said("system", F.lit(system)), said("user", F.col("q")), said("assistant", F.col("d"))).alias("messages"))
    return good, rows.where("error is not null").select("n", "error")


def base_columns(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """What a scorer is trained on and gives scores to: labels, words of head and tail, numbers and relation."""
    text = lambda e: X.tokens(F.concat_ws(" ", f"{e}_type", f"{e}_content"))
    relations = F.array(*(F.lit(r) for r in _relations()))
    return edges.select(
        *(keep or []), "sample_key", "split", "sample_id", F.coalesce("tier_label", F.lit(0)).cast("double").alias("label"), F.coalesce("include_in_loss", F.lit(False)).alias("loss"), binary_label(F.col("source_type"), F.col("base_tier")).alias("edge"),
        F.coalesce("heuristic_score", F.lit(0.0)).alias("hs"), heuristic_label(F.col("source_type"), F.col("heuristic_tier"), F.col("base_tier")).alias("ht"), text("head").alias("hw"), text("tail").alias("tw"),
        *(c.alias(f"f{i}") for i, c in enumerate(numeric())), *((F.coalesce(F.array_position(relations, F.col("relation")), F.lit(0)) == i + 1).cast("double").alias(f"r{i}") for i in range(len(_relations()))),
    )


def trained_scorer(edges: DataFrame, seeds: tuple[int, ...] = (0, 1, 2), hidden: int = 32, rounds: int = 60, terms: int = 200, width: int = 16):
    """(edges with score and tier, metrics of each seed, the best model): a multilayer perceptron over the features, of
    which text terms are reduced to ``width`` by principal components, trained on the train split for each seed; the best by the dev split scores all.

    edges: a supervision table. Rows out of the loss aren't trained on. Where a split has no row, the training rows stand in.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import PCA, HashingTF, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base = base_columns(edges)
    cols = [f"f{i}" for i in range(14)] + [f"r{i}" for i in range(len(_relations()))]
    stages = [HashingTF(inputCol="hw", outputCol="hv", numFeatures=terms, binary=True), HashingTF(inputCol="tw", outputCol="tv", numFeatures=terms, binary=True), PCA(k=width, inputCol="hv", outputCol="hp"), PCA(k=width, inputCol="tv", outputCol="tp"), VectorAssembler(inputCols=["hp", "tp", *cols], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features")]
    train = base.where("split = 'train' and loss")
    prepared = Pipeline(stages=stages).fit(train)
    x, xt = prepared.transform(base), prepared.transform(train)
    dev = x.where("split = 'dev' and loss")
    dev = xt if dev.isEmpty() else dev
    p = vector_to_array("probability")

    def scored(model, rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("s", F.round(p[1] + p[2], 6)).withColumn("t", F.col("prediction").cast("int")).withColumn("tier", F.col("label").cast("int"))

    runs, models = None, {}
    for seed in seeds:
        models[seed] = MultilayerPerceptronClassifier(layers=[2 * width + len(cols), hidden, 3], maxIter=rounds, seed=seed, blockSize=128).fit(xt)
        one = evaluated(scored(models[seed], dev)).withColumn("seed", F.lit(seed))
        runs = one if runs is None else runs.unionByName(one)
    best = best_seed(runs).first()["seed"] if len(seeds) > 1 else seeds[0]
    return scored(models[best], x), runs, (prepared, models[best])


def two_heads(edge: Column, hyperedge: Column) -> Column:
    """The score of a scorer with two heads: the mean of their sigmoids."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return (sigmoid(edge) + sigmoid(hyperedge)) / 2


def as_training_rows(triples: DataFrame) -> DataFrame:
    """Edges of a graph in the layout of supervision rows, so that a trained scorer can score them."""
    from talkgraph.operators.triples import modality_summary

    keep = ["sample_id", "head_id", "head_type", "head_content", "relation", "tail_id", "tail_type", "tail_content", "is_repaired"]
    x = modality_summary(triples, keep)
    part = lambda m, fields: F.struct(*(F.col(f"{m}_{a}").alias(b) for a, b in fields))
    has = lambda m: (F.col(f"{m}_count") > 0).cast("int")
    none = F.lit(None).cast("string")
    return x.select(
        F.concat_ws("|", F.coalesce("head_id", F.lit("")), "relation", F.coalesce("tail_id", F.lit(""))).alias("sample_key"), F.lit("all").alias("split"), *keep,
        part("audio", (("count", "count"), ("quality_max", "quality_max"), ("duration_sum", "duration_sum"))).alias("audio_repr"), part("visual", (("count", "count"), ("quality_max", "quality_max"), ("has_chart", "has_chart_hint"))).alias("visual_repr"),
        part("paper", (("count", "count"), ("quality_max", "quality_max"), ("repaired_count", "repaired_count"), ("similarity_max", "similarity_max"))).alias("paper_repr"), F.struct(has("audio").alias("audio"), has("visual").alias("visual"), has("paper").alias("paper")).alias("modality_mask"),
        F.lit(None).cast("int").alias("tier_label"), F.lit(False).alias("include_in_loss"), none.alias("source_type"), none.alias("base_tier"), F.lit(None).cast("double").alias("heuristic_score"), none.alias("heuristic_tier"),
    )


def scored_edges(triples: DataFrame, fitted) -> DataFrame:
    """(head_id, relation, tail_id, score): every distinct edge scored by a fitted (preparation, model), the best of its rows, in six places."""
    prepared, model = fitted
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    x = model.transform(prepared.transform(base_columns(as_training_rows(triples.where("head_id is not null and tail_id is not null")), ["head_id", "relation", "tail_id"])))
    return x.groupBy("head_id", "relation", "tail_id").agg(F.round(F.max(p[1] + p[2]), 6).alias("score"))


def _relations() -> list[str]:
    from talkgraph.functions import ontology as O

    return list(O.CONSTRAINTS)


def rerank_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows and kept rows per split and session, with the totals."""
    kept = F.col("score") >= threshold
    r = scored.rollup("split", "sample_id").agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"), F.grouping_id().alias("level"))
    return r.select(F.when(F.col("level") == 3, "all").otherwise(F.col("split")).alias("split"), F.when(F.col("level") >= 1, "all").otherwise(F.col("sample_id")).alias("sample_id"), "n", "n_kept")


def running_rates(results: DataFrame, order: str) -> DataFrame:
    """After each result the rates so far: (order, done, accuracy, answerable_accuracy, refusal_rate); nulls where nothing has been judged."""
    w = Window.orderBy("_b")
    e = "llm_evaluation"
    open_, right = F.coalesce(F.col(f"{e}.is_unanswerable"), F.lit(False)), F.coalesce(F.col(f"{e}.is_correct"), F.lit(False))
    refused = F.coalesce(F.col(f"{e}.properly_refused"), F.lit(False))
    good = F.when(open_, refused).otherwise(right).cast("int")
    r = results.select(F.col(order), good.alias("good"), (~open_).cast("int").alias("a"), (~open_ & right).cast("int").alias("ar"), open_.cast("int").alias("u"), (open_ & refused).cast("int").alias("ur"))
    # totals of stretches of the order come first, so that no task has more than a stretch
    cols = ("one", "good", "a", "ar", "u", "ur")
    r = r.withColumn("one", F.lit(1)).withColumn("_b", F.floor(F.col(order) / STRETCH))
    sums = r.groupBy("_b").agg(*(F.sum(c).alias(c) for c in cols))
    before = sums.select("_b", *((F.sum(c).over(w) - F.col(c)).alias(f"p_{c}") for c in cols))
    own = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = r.select(order, "_b", *(F.sum(c).over(own).alias(c) for c in cols)).join(before, "_b").select(order, *((F.col(c) + F.col(f"p_{c}")).alias(c) for c in cols))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return x.select(order, F.col("one").alias("done"), rate("good", "one").alias("accuracy"), rate("ar", "a").alias("answerable_accuracy"), rate("ur", "u").alias("refusal_rate"))


#: Ids of one stretch of running_rates().
STRETCH = 10_000
