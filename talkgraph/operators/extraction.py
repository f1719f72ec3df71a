"""Triples from claim windows: payloads within a budget, extraction by a provider, and widening rounds until a session has enough."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgraph.functions import text as X
from talkgraph.functions.shared import written
from talkgraph.operators import providers
from talkgraph.operators import triples as T
from talkgraph.operators.learning import resume
from talkgraph.operators.scoring import json_in
from talkgraph.sources.readers import PROVENANCE

#: The widening rounds: claims' related nodes and chunks that a window holds.
ROUNDS = ({"chunks": 4, "nodes": 4}, {"chunks": 8, "nodes": 8}, {"chunks": 12, "nodes": 12})
_TRIPLE = f"struct<head:struct<id:string,type:string,content:string>,relation:string,tail:struct<id:string,type:string,content:string>,provenance:{PROVENANCE},weight:double,signal_source:string>"
#: Traces of repairs.
TRACE = "array<struct<modality:string,repair_method:string,repaired_granularity:string,reason:string,utterance_id:string,slide_id:string,region_id:string,chunk_id:string,time:double,similarity_score:double>>"


def tokens_of(payload: Column) -> Column:
    """A rough count of a JSON payload's tokens, a quarter of its characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(payload)) / 4).cast("int"))


def windows(claims: DataFrame, related: DataFrame, evidence: DataFrame, chunks: int, nodes: int) -> DataFrame:
    """(sample_id, claim, related, chunks) of each claim (sample_id, id, type, content): the first related nodes (claim_id, rk,
    id, type, content) and evidence chunks (claim_id, pos, chunk_id, text)."""
    few = lambda df, o, n, fields, name: df.where(F.col(o) <= n).groupBy(F.col("claim_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(o, *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    out = claims.join(few(related, "rk", nodes, ["id", "type", "content"], "related"), "id", "left").join(few(evidence, "pos", chunks, ["chunk_id", "text"], "chunks"), "id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select("sample_id", F.struct("id", "type", "content").alias("claim"), empty("related", "array<struct<id:string,type:string,content:string>>").alias("related"), empty("chunks", "array<struct<chunk_id:string,text:string>>").alias("chunks"))


def widened(chunks: Column, most: int = 2200, lap: int = 250) -> Column:
    """Chunks longer than a window cut into overlapping parts of their own ids; others stay."""
    part = lambda c: F.transform(X.semantic_windows(c["text"], most, lap), lambda t, i: F.struct(F.concat(c["chunk_id"], F.lit("#part_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("chunk_id"), t.alias("text")))
    return F.flatten(F.transform(chunks, lambda c: F.when(F.length(F.coalesce(c["text"], F.lit(""))) > most, part(c)).otherwise(F.array(c))))


def shards(window_rows: DataFrame, budget: int = 7000, most: int = 4) -> DataFrame:
    """Each window in as many shards (shard, shards) as its estimated tokens need, a power of two, but no more than
    ``most`` or than it has chunks; the chunks are dealt out evenly and empty shards are left out."""
    w = window_rows.withColumn("chunks", widened(F.col("chunks")))
    est = tokens_of(F.struct("claim", "related", "chunks"))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), est / F.lit(float(max(1, budget)))))))
    n = F.least(power, F.lit(most), F.greatest(F.lit(1), F.size("chunks"))).cast("int")
    w = w.withColumn("shards", F.when(est <= budget, 1).otherwise(n)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    size, at = F.size("chunks"), lambda i: F.floor(size * i / F.col("shards")).cast("int")
    out = w.withColumn("part", F.slice("chunks", at(F.col("shard")) + 1, at(F.col("shard") + 1) - at(F.col("shard"))))
    return out.where((F.size("part") > 0) | (F.col("shards") == 1)).select("sample_id", "claim", "related", F.col("part").alias("chunks"), "shard", "shards")


def offline_extraction(payloads: list[str]) -> list[str]:
    """Offline default of the extraction model: the claim is supported by its results and by each chunk that shares a word
    of length with it; results are measured by the metrics they name."""
    out = []
    for text in payloads:
        p = json.loads(text)
        claim, made = p["claim"], []
        long = {w for w in (claim.get("content") or "").lower().split() if len(w) > 5}
        seen = [c for c in p["chunks"] if long & set((c.get("text") or "").lower().split())]
        prov = [{"source_type": "paper", "chunk_id": c["chunk_id"]} for c in seen[:2]]
        for n in p["related"]:
            if n["type"] == "Result":
                made.append({"head": claim, "relation": "supported_by", "tail": n, "provenance": prov, "weight": 0.8})
        for c in seen:
            made.append({"head": claim, "relation": "supported_by", "tail": {"id": c["chunk_id"], "type": "PaperChunk", "content": (c.get("text") or "")[:200]}, "provenance": [{"source_type": "paper", "chunk_id": c["chunk_id"]}], "weight": 0.7})
        metrics = [n for n in p["related"] if n["type"] == "Metric" and n.get("content")]
        for n in p["related"]:
            if n["type"] == "Result":
                made += [{"head": n, "relation": "measured_by", "tail": m, "provenance": prov, "weight": 0.6} for m in metrics if set(m["content"].lower().split()) & set((n.get("content") or "").lower().split())]
        out.append("```json\n" + json.dumps({"triples": made}, ensure_ascii=False) + "\n```")
    return out


def extracted(shard_rows: DataFrame, provider: providers.Provider = offline_extraction, dead: str | None = None, lanes: int | None = None) -> DataFrame:
    """Triples that a provider finds in shards, as valid() wants them. Replies without sound JSON give none; with ``dead`` they are kept there."""
    asked = shard_rows.select("sample_id", F.to_json(F.struct("claim", "related", "chunks")).alias("payload"))
    got = providers.called(asked, "payload", "reply", "string", provider, lanes=lanes, dead=dead).withColumn("json", json_in(F.col("reply")))
    if dead:
        got = written(got, "extracted")
        got.where("reply is not null and json is null").select("payload", "reply").write.mode("append").json(dead)
    t = got.select("sample_id", F.explode(F.from_json("json", f"struct<triples:array<{_TRIPLE}>>")["triples"]).alias("t"))
    end = lambda e: [F.col(f"t.{e}.{f}").alias(f"{e}_{f}") for f in ("id", "type", "content")]
    flat = t.select("sample_id", *end("head"), F.col("t.relation").alias("relation"), *end("tail"), F.col("t.provenance").alias("provenance"), F.col("t.weight").alias("weight"), F.col("t.signal_source").alias("signal_source"))
    return T.valid(flat)


def merged(found: DataFrame) -> DataFrame:
    """One row per edge of a session from the triples of all rounds."""
    rows = found.withColumn("triple_id", F.xxhash64("sample_id", "head_id", "relation", "tail_id", "weight", F.to_json("provenance"))).withColumn("is_repaired", F.lit(False))
    own = T.merged(rows)
    kept = rows.groupBy("head_id", "relation", "tail_id").agg(*(F.min(c).alias(c) for c in ("sample_id", "head_type", "head_content", "tail_type", "tail_content")))
    out = own.join(kept, ["head_id", "relation", "tail_id"])
    return out.withColumns({"triple_id": F.xxhash64("head_id", "relation", "tail_id"), "repair_trace": F.lit(None).cast(TRACE)})


def graph(claims: DataFrame, related: DataFrame, evidence: DataFrame, provider: providers.Provider = offline_extraction, rounds: tuple = ROUNDS, budget: int = 7000, enough: Callable[[DataFrame], DataFrame] = T.coverage) -> tuple[DataFrame, DataFrame]:
    """(merged triples, trace): in each round the sessions that have not passed yet are asked with wider windows.

    A round is one job over all sessions left; its triples are written and united with those before. trace: round, sessions asked, triples found.
    """
    found, trace, left = None, [], claims.select("sample_id").distinct()
    for n, width in enumerate(rounds):
        asked = claims.join(left, "sample_id", "left_semi")
        got = written(extracted(shards(windows(asked, related, evidence, **width), budget), provider), f"round-{n}")
        found = got if found is None else written(found.unionByName(got), f"found-{n}")
        trace.append((n, left.count(), got.count()))
        passed = enough(merged(found)).where("passed").select("sample_id", F.lit("ok").alias("status"))
        left = written(resume(left, passed, "sample_id"), f"left-{n}")
        if left.isEmpty():
            break
    return merged(found), claims.sparkSession.createDataFrame(trace, "round int, sessions bigint, triples bigint")


def with_repair(triples: DataFrame, repairs: DataFrame) -> DataFrame:
    """triples with the item and trace of their repair appended and marked as repaired. repairs: triple_id, item (a provenance
    item), entry (a trace item), one row a triple; triples without one stay as they are."""
    add = lambda c, new: F.when(F.col(new).isNotNull(), F.concat(F.coalesce(c, F.array().cast(dict(triples.dtypes)[c])), F.array(new))).otherwise(F.col(c))
    out = triples.join(repairs.select("triple_id", "item", "entry"), "triple_id", "left")
    return out.withColumns({"provenance": add("provenance", "item"), "repair_trace": add("repair_trace", "entry"), "is_repaired": F.coalesce("is_repaired", F.lit(False)) | F.col("item").isNotNull()}).drop("item", "entry")


def scored_and_repaired(triples: DataFrame, slide_repairs: DataFrame, paper_repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples with slide and paper repairs, scored and tiered anew; counts of repairs per session).

    slide_repairs: triple_id, slide_id, region_id, reason; paper_repairs: triple_id, chunk_id, similarity.
    """
    from talkgraph.operators.evidence import paper_targets, repair_targets

    kinds = dict(triples.dtypes)
    item = lambda **f: F.from_json(F.to_json(F.struct(*(v.alias(k) for k, v in f.items()))), kinds["provenance"][6:-1])
    entry = lambda **f: F.from_json(F.to_json(F.struct(*(v.alias(k) for k, v in f.items()))), kinds["repair_trace"][6:-1])
    level = F.when(F.col("region_id").isNull(), "page_level").otherwise("region_level")
    common = {"repaired_granularity": level, "slide_id": F.col("slide_id"), "region_id": F.col("region_id"), "repair_method": F.lit("temporal_alignment")}
    s = slide_repairs.select("triple_id", item(source_type=F.lit("slide"), is_repaired=F.lit(True), **common).alias("item"), entry(modality=F.lit("slide"), reason=F.col("reason"), **common).alias("entry"), level.alias("level"))
    near = {"repair_method": F.lit("dense_retrieval"), "chunk_id": F.col("chunk_id"), "similarity_score": F.col("similarity")}
    p = paper_repairs.select("triple_id", item(source_type=F.lit("paper"), is_repaired=F.lit(True), **near).alias("item"), entry(modality=F.lit("paper"), **near).alias("entry"))
    out = T.scored(with_repair(with_repair(triples, s), p))
    tried = lambda df, name: df.groupBy("sample_id").agg(F.count("*").alias(name))
    own = triples.select("triple_id", "sample_id")
    did = own.join(s.select("triple_id", "level"), "triple_id").groupBy("sample_id").agg(F.count_if(F.col("level") == "region_level").alias("slide_region"), F.count_if(F.col("level") == "page_level").alias("slide_page"))
    stats = own.select("sample_id").distinct()
    for x in (tried(repair_targets(triples), "slide_attempted"), did, tried(paper_targets(triples), "paper_attempted"), tried(own.join(p.select("triple_id"), "triple_id"), "paper_repaired")):
        stats = stats.join(x, "sample_id", "left")
    return out, stats.fillna(0)


