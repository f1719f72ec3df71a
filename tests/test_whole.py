"""Registered queries over whole tables, beside brute force."""

import hashlib
import re

from talkgraph.functions import ontology as O
from talkgraph.plans import evidence, learning, timeline

PROV = "array<struct<source_type:string,slide_id:string,region_id:string,chunk_id:string,page:int>>"


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def noisy(text):
    t = " ".join((text or "").split())
    n, alnum = len(t), sum(c.isalnum() for c in t)
    punct = sum(not c.isalnum() and not c.isspace() for c in t)
    return not t or n >= 120 and (alnum / n < 0.30 and punct / n > 0.35 or "…" in t and punct / n > 0.42)


def test_noise_of_long_chunks(spark, tmp_path):
    texts = ["±§" * 70, "±§" * 40, "ab…" + ".." * 30 + " cde" * 20, "ab…" + "...." * 30 + " cde" * 20, "word " * 40, "ab " + "...." * 30 + " cde" * 20, "a" * 36 + "±" * 84, "a" * 35 + "±" * 85, "a" * 35 + "±" * 84, "  ", None, "é" * 200]
    d = stored(spark, tmp_path, paper_chunks=([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string"))
    want = {f"c{i}": noisy(t) for i, t in enumerate(texts)}
    assert {r["chunk_id"]: r["noisy"] for r in timeline.QUERIES["pred06_embedding_noise"](spark, d).collect()} == want
    assert sum(want.values()) > 3


def test_paper_repairs_of_every_relation(spark, tmp_path):
    rows = [(i, "s", r, "dense encoder", "sparse decoder", []) for i, r in enumerate(O.WEIGHTS)] + [(90 + i, "s", r, "dense encoder", "sparse decoder", [("paper", None, None, "c1", 1)]) for i, r in enumerate(O.WEIGHTS)]
    chunks = [("s", f"c{i}", f"dense encoder {p} sparse decoder") for i, p in enumerate(O.PHRASES.values())] + [("z", "c9", "dense encoder sparse decoder")]
    d = stored(spark, tmp_path, kg_triples=(rows, f"triple_id int, sample_id string, relation string, head_content string, tail_content string, provenance {PROV}"), paper_chunks=(chunks, "sample_id string, chunk_id string, text string"))
    got = {r["triple_id"]: (r["chunk_id"], r["similarity"]) for r in evidence.j29_paper_repairs(spark, d).collect()}
    where = {r: f"c{i}" for i, r in enumerate(O.PHRASES)}
    assert got == {i: (where[r], 1.0) for i, (r, w) in enumerate(O.WEIGHTS.items()) if w[2] > 0} and len(got) == 6


NODES = [("s", f"n{i}", t, c) for i, (t, c) in enumerate([("Claim", "dense encoder wins"), ("Dataset", "FooSet of talks"), ("Metric", "recall at ten"), ("Limitation", "slow decoder"), ("Method", "sparse decoder"), ("Result", "recall of nine"), ("Claim", None)])]
TEXTS = ["the dense encoder", "recall at nine", "a slow decoder of talks", "FooSet", "sparse words", "nothing shared", "ten talks of nine"]


def toks(t):
    return set(re.findall("[a-z0-9_]+", (t or "").lower()))


def best(score, k=3):
    """node -> its k best texts by brute force."""
    out = {}
    for _, n, _, c in NODES:
        scored = sorted((-round(score(toks(c), toks(t)), 6), i) for i, t in enumerate(TEXTS) if toks(c) & toks(t))
        out[n] = [i for _, i in scored[:k]]
    return out


def test_evidence_of_nodes_of_every_type(spark, tmp_path):
    d = stored(
        spark, tmp_path,
        evidence_links=(NODES, "sample_id string, node_id string, node_type string, content string"),
        paper_chunks=([("s", f"c{i}", t) for i, t in enumerate(TEXTS)] + [("z", "c9", "dense encoder wins")], "sample_id string, chunk_id string, text string"),
        utterances=([("s", f"u{i}", t, float(i), i + 1.0) for i, t in enumerate(TEXTS)], "sample_id string, utterance_id string, text string, start_time double, end_time double"),
        slides=([("s", "p1", 0.0, 99.0)], "sample_id string, slide_id string, start_time double, end_time double"),
        visual_regions=([("p1", "r1", "x", None, None, None)], "slide_id string, region_id string, ocr_text string, visual_summary string, chart_type string, entities array<string>"),
    )
    jac, over = best(lambda a, b: len(a & b) / len(a | b)), best(lambda a, b: len(a & b) / min(len(a), len(b)))
    assert all(v for n, v in jac.items() if n != "n6") and jac["n6"] == []
    rows = {r["node_id"]: r for r in evidence.j10_evidence_links(spark, d).collect()}
    assert {n: r["chunks"] for n, r in rows.items()} == {n: "|".join(f"c{i}" for i in v) for n, v in jac.items()}
    assert {n: r["utterances"] for n, r in rows.items()} == {n: "|".join(f"u{i}" for i in v) for n, v in over.items()}
    for name, col, pre, want in (("j08_jaccard_topk", "chunk_id", "c", jac), ("j09_overlap_topn", "utterance_id", "u", over)):
        got = {(r["node_id"], r["rk"], r[col]) for r in learning.QUERIES[name](spark, d).collect()}
        assert got == {(n, k, f"{pre}{i}") for n, v in want.items() for k, i in enumerate(v, 1)}


def test_hard_negatives_of_every_split(spark, tmp_path):
    h, r, t = O.allowed()[0]
    pos = [(f"e{i}", "s", split, "h", h, "dense encoder", r, "t0", t, "recall of nine", None) for i, split in enumerate(["train", "dev", "test"])] + [("e9", "s", "train", "h", h, "x", r, "t0", t, "y", "paper_hard")]
    pool = [("s", f"t{i}", t, c) for i, c in enumerate(["recall of nine", "recall", "dense recall", "recall of ten", "other", "nine"])] + [("z", "t9", t, "recall of nine")]
    d = stored(
        spark, tmp_path,
        supervision=(pos, "sample_key string, sample_id string, split string, head_id string, head_type string, head_content string, relation string, tail_id string, tail_type string, tail_content string, negative_type string"),
        evidence_links=(pool, "sample_id string, node_id string, node_type string, content string"),
        kg_triples=([("h", r, "t3")], "head_id string, relation string, tail_id string"),
    )
    jac = lambda a, b: len(a & b) / max(1, len(a | b))
    sim = lambda c: round(jac(toks("recall of nine"), toks(c)) + 0.15 * jac(toks("dense encoder"), toks(c)), 6)
    order = sorted((-sim(c), hashlib.md5(f"{n}|42".encode()).hexdigest(), n) for s, n, _, c in pool if s == "s" and n not in ("t0", "t3"))
    want = {(f"e{i}", n, k) for i in range(3) for k, (_, _, n) in enumerate(order[:2], 1)}
    assert {(x["edge_id"], x["neg_tail"], x["rk"]) for x in learning.QUERIES["j22_hard_negatives"](spark, d).collect()} == want
