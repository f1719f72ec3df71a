"""From questions to answers: contexts of several kinds, prompts, a chat model, a judge, metrics and summaries.

All steps work on tables of questions; models are providers with offline defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.functions.shared import written
from talkgraph.operators import blocks as B
from talkgraph.operators import learning as M
from talkgraph.operators import providers, retrieval as R

_ROLE = "You answer questions about talks and their papers."


def plain_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{_ROLE}\nUse the evidence; where it says too little, give what it supports.\nEvidence:\n"), F.coalesce(context, F.lit("")), F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def graph_prompt(question: Column, lines: Column, n_nodes: Column, types: Column, n_edges: Column) -> Column:
    """With what the graph holds, so that the model can follow relations."""
    head = F.format_string("The graph has %d nodes (%s) and %d relations.\n", n_nodes, types, n_edges)
    return F.concat(F.lit(f"{_ROLE}\n"), head, F.coalesce(lines, F.lit("")), F.lit("\nFollow the relations to what the question asks for.\nQuestion: "), question, F.lit("\nAnswer:"))


def hyperedge_context(centers: Column, contents: Column) -> Column:
    """Lines of the first centers with the evidence and relations they have, then of the first contents.

    centers: array of (content, n_chunks, n_slides, n_regions, n_utterances, relations); contents: array of strings.
    """
    some = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    each = lambda c: F.concat_ws("\n", F.concat(F.lit("Center: "), F.substring(c["content"], 1, 300)), F.nullif(F.concat(F.lit("  Evidence: "), F.concat_ws(", ", some(c["n_chunks"], "paper passages"), some(c["n_slides"], "slides"), some(c["n_regions"], "regions"), some(c["n_utterances"], "utterances"))), F.lit("  Evidence: ")), F.concat(F.lit("  Relations: "), F.array_join(c["relations"], ", ")))
    more = F.transform(F.slice(contents, 1, 8), lambda t, i: F.concat(F.lit("Also "), (i + 1).cast("string"), F.lit(": "), F.substring(t, 1, 300)))
    return F.concat_ws("\n", F.array_join(F.transform(F.slice(centers, 1, 5), each), "\n"), F.array_join(more, "\n"))


def subgraphs(top: DataFrame, contents: DataFrame, modalities: DataFrame, first: int = 10) -> DataFrame:
    """(qid, nodes, edges, score, centers): each question's triples (qid, rk, head_id, relation, tail_id, score) as a graph.

    nodes: (pos, node_id, type, content), heads before tails, each once; edges in order of rank; score: the sum of the first
    ``first`` scores over the number of triples; centers: heads (contents' node_id) with at least two modalities.
    """
    nodes = R.subgraph_nodes(top, contents)
    n = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "type", "content"))).alias("nodes"))
    e = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "head_id", "relation", "tail_id"))).alias("edges"), F.round(F.sum(F.when(F.col("rk") <= first, F.col("score")).otherwise(0.0)) / F.greatest(F.lit(1), F.count("*")), 6).alias("score"))
    heads = top.groupBy("qid", "head_id").agg(F.min("rk").alias("rk")).join(modalities.where("modality_count >= 2").withColumnRenamed("node_id", "head_id"), "head_id")
    c = heads.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "head_id"))), lambda x: x["head_id"]).alias("centers"))
    return n.join(e, "qid").join(c, "qid", "left")


def laid(pieces: DataFrame) -> DataFrame:
    """(session_id, off, text): where each piece (session_id, part, key, text) begins in its session's text, which has the pieces
    of its three parts in order, a line each; an empty part leaves an empty line. The whole text is never in one row."""
    w = Window.partitionBy("session_id").orderBy("part", "key", "text")
    last, following = F.lag("part").over(w), F.lead("part").over(w)
    before = F.when(last.isNull(), F.col("part")).otherwise(F.greatest(F.lit(1), F.col("part") - last))
    lines = lambda n: F.repeat(F.lit("\n"), n)
    led = pieces.withColumns({"b": before, "a": F.when(following.isNull(), 2 - F.col("part")).otherwise(0)}).select("session_id", "part", "key", "text", F.concat(lines(F.col("b")), "text", lines(F.col("a"))).alias("t"))
    off = F.coalesce(F.sum(F.length("t").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return led.select("session_id", off.alias("off"), F.col("t").alias("text"))


def raw_windows(texts: DataFrame, size: int = 500, lap: int = 100, cut: int = 2000) -> DataFrame:
    """(session_id, window, text): windows of the text of each session, without the graph.

    texts: session_id, text; with off, a text is the piece of its session's text that begins there. Pieces are cut up and each
    goes to the windows it reaches, as finding a window's place in a long text costs the text's length.
    """
    step = size - lap
    at = texts.withColumn("off", F.col("off") if "off" in texts.columns else F.lit(0).cast("bigint")).where("text <> ''")
    bits = F.when(F.length("text") <= cut, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{cut}}}"), 0))
    p = at.select("session_id", "off", F.posexplode(bits).alias("j", "x")).select("session_id", (F.col("off") + F.col("j") * cut).alias("off"), "x", F.length("x").alias("n"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("off") - size) / step) + 1), F.floor((F.col("off") + F.col("n") - 1) / step)
    p = p.select("*", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("i"))
    begin, end = F.greatest(F.lit(0), F.col("i") * step - F.col("off")), F.least(F.col("n"), F.col("i") * step + size - F.col("off"))
    own = p.select("session_id", "i", "off", F.substring("x", (begin + 1).cast("int"), (end - begin).cast("int")).alias("x"))
    whole = own.groupBy("session_id", "i").agg(F.array_sort(F.collect_list(F.struct("off", "x"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["x"]), "")
    return whole.select("session_id", F.concat_ws("#", "session_id", (F.col("i") * step).cast("string")).alias("window"), F.trim(text).alias("text")).where("text <> ''")


def nearest_windows(questions: DataFrame, windows: DataFrame, k: int = 10, provider: providers.Provider = providers.hashed_embedding, normalize: bool = True) -> DataFrame:
    """(qid, window, score, rk): for each question (qid, session_id, question) the nearest windows of its session; inner
    products of vectors as the provider gives them, or of unit length. Vectors are written, so that each text is embedded once; those of
    no direction (texts without words) meet nothing where unit length is asked for."""
    from talkgraph.functions.vectors import unit

    scaled = F.when(F.exists("embedding", lambda x: x != 0), unit(F.col("embedding"))) if normalize else F.col("embedding")
    own = lambda df, c: providers.embedded(df, c, provider).where("embedding is not null").withColumn("v", scaled)
    sound = lambda df: df.where(~F.exists("v", lambda x: F.isnan(x) | x.isNull()))
    left = own(questions.where("question is not null"), "question").select("session_id", F.col("qid").alias("lid"), "v")
    right = own(windows, "text").select("session_id", F.col("window").alias("rid"), "v")
    left, right = sound(written(left, "question-vectors")).withColumn("need", F.lit(k)), sound(written(right, "window-vectors"))
    return B.best(left, right, ["session_id"], lambda a, b: B.half_up(B.products(a["v"], b["v"]), 6)).select(F.col("lid").alias("qid"), F.col("rid").alias("window"), "score", "rk")


def context_of(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(qid, context): the windows' texts in order of rank."""
    t = hits.join(windows.select("window", "text"), "window").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "text"))).alias("x"))
    return t.select("qid", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("context"))


def answered(questions: DataFrame, contexts: DataFrame, model: providers.Provider = providers.keyword_answer, dead: str | None = None) -> DataFrame:
    """questions (qid, session_id, question, answer, answerable) with prompt, generated answer and error. A question without
    a context is asked without; one whose model fails for good has an error and no answer."""
    q = questions.join(contexts, "qid", "left").withColumn("prompt", plain_prompt(F.coalesce("question", F.lit("")), F.col("context")))
    out = providers.called(q, "prompt", "reply", "string", model, dead=dead)
    return out.withColumn("generated_answer", X.without_thinking(F.col("reply"))).withColumn("error", F.when(F.col("reply").isNull(), "no reply")).drop("reply", "prompt")


def judged(answers: DataFrame, retrieved: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """Result rows with the judge's verdict and, where gold nodes are given, precision, recall and F1 of what was retrieved.

    answers: as answered(); retrieved, gold: qid, ids. Unanswerable questions ask for a refusal.
    """
    a = answers.withColumn("ground_truth_answer", F.col("answer"))
    a = providers.judged(a)
    open_ = ~F.coalesce("answerable", F.lit(True))
    held = F.coalesce(F.contains(F.lower("context"), F.lower("ground_truth_answer")), F.lit(False))
    a = a.withColumn("llm_evaluation", F.struct(F.when(~open_, F.coalesce("is_correct", F.lit(False))).alias("is_correct"), F.coalesce("properly_refused", F.lit(False)).alias("properly_refused"), open_.alias("is_unanswerable"), held.alias("context_supports_answer")))
    if retrieved is not None and gold is not None:
        a = a.join(gold.select("qid", F.col("ids").alias("_g")), "qid", "left").join(retrieved.select("qid", F.col("ids").alias("_r")), "qid", "left")
        none = F.array().cast("array<string>")
        p, r, f = M.retrieval_f1(F.coalesce("_g", none), F.coalesce("_r", none))
        a = a.withColumn("retrieval_metrics", F.struct(F.round(p, 4).alias("node_precision"), F.round(r, 4).alias("node_recall"), F.round(f, 4).alias("node_f1"))).drop("_g", "_r")
    else:
        a = a.withColumn("retrieval_metrics", F.lit(None).cast("struct<node_precision:double,node_recall:double,node_f1:double>"))
    return a.select("qid", "session_id", "question", "ground_truth_answer", "generated_answer", "retrieval_metrics", "llm_evaluation", F.lit(0.0).alias("timing"), "error")


def evaluated(questions: DataFrame, contexts: DataFrame, path: str, batch: int = 1000, model: providers.Provider = providers.keyword_answer) -> tuple[DataFrame, DataFrame]:
    """(results, summary): questions without a sound result in ``path`` are answered, judged and appended in batches of about
    ``batch``; results that failed before are asked again. The summary is over the last result of each question."""
    spark = questions.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    left = questions
    if there:
        left = M.resume(questions, spark.read.parquet(path).select("qid", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")), "qid", ("failed",))
    left = written(left, "to-answer")
    n = max(1, -(-left.count() // batch))
    for i in range(n):
        part = left.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        judged(answered(part, contexts, model)).withColumn("batch", F.current_timestamp()).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    w = Window.partitionBy("qid").orderBy(F.col("error").isNotNull().cast("int"), F.desc("batch"))
    last = every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return last, M.qa_summary(last)


def reevaluated(results: DataFrame, judge: str = "offline") -> tuple[DataFrame, DataFrame]:
    """(results judged anew, one summary row) of stored results that have an answer."""
    sound = results.where("generated_answer is not null and (error is null or trim(error) = '')")
    again = providers.judged(sound)
    open_ = F.coalesce("llm_evaluation.is_unanswerable", F.lit(False))
    good = F.when(open_, F.coalesce("properly_refused", F.lit(False))).otherwise(F.coalesce("is_correct", F.lit(False)))
    rows = again.withColumn("good", good).withColumn("open", open_)
    rate = lambda when, base: F.round(F.try_divide(F.count_if(when & base), F.count_if(base)), 6)
    s = rows.agg(F.lit(judge).alias("judge"), F.count("*").alias("n"), rate(F.col("good"), F.lit(True)).alias("overall_accuracy"), rate(F.col("good"), ~F.col("open")).alias("answerable_accuracy"), rate(F.col("good"), F.col("open")).alias("refusal_rate"))
    return rows, s


def drawn(parts: DataFrame, provider: providers.Provider, passes: tuple[str, ...] = ("entities", "relations"), size: int = 6000) -> DataFrame:
    """(session_id, kind, item): what a model draws from each stretch of each session's text (session_id, text), one pass a
    kind, each item once. The model answers with a JSON list of strings."""
    out = None
    for kind in passes:
        cut = parts.select("session_id", F.explode(X.char_windows(F.col("text"), size, 0)).alias("w")).select("session_id", F.concat(F.lit(f"{kind}:\n"), F.col("w.text")).alias("p"))
        got = providers.called(cut, "p", "r", "string", provider).select("session_id", F.lit(kind).alias("kind"), F.explode(F.from_json("r", "array<string>")).alias("item")).where("trim(item) <> ''").distinct()
        out = got if out is None else out.unionByName(got)
    return out
