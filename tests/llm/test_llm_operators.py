"""Operators for training data: hand-made cases, brute force, round trips and held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from talkgraph.llm import copies, encode, fusion, leaks, mojibake, nearest, overlaps, pairs, scans

KG = "triple_id bigint, sample_id string, relation string, head_content string, tail_content string, extra string, _id string, keep_id string"
KEY = {"id_col": "triple_id", "exact": ["sample_id", "relation"], "text": ["head_content", "tail_content"]}


def groups(spark, rows):
    df = spark.createDataFrame([(i, s, r, h, t, "e", "x", "y") for i, s, r, h, t in rows], KG)
    return {(r["keep_id"], r["triple_id"]) for r in copies.members(df, **KEY).collect()}, df


def test_copies(spark):
    rows = [
        (1, "s", "r", "method: A-b; value: -1.5", "Tail"), (2, "s", "r", "VALUE : −1.5|method :a B ", "tail."), (3, "s", "r", "method: A-b; value: 1.5", "Tail"), (4, "s", "r", "method: A-b; value: -15", "Tail"),
        (5, "s", "r", "Tail", "method: A-b; value: -1.5"), (6, "z", "r", "method: A-b; value: -1.5", "Tail"), (7, "s", "q", "method: A-b; value: -1.5", "Tail"), (8, "s", "r", None, "Tail"), (9, "s", "r", "", "Tail"),
        (10, "s", "r", None, "tail"), (11, "s", "r", "...", "Tail"), (12, None, None, "a", "b"), (13, None, None, "A", "b!"), (14, "s", "r", "a; a; b", "x"), (15, "s", "r", "b; a; a", "x"), (16, "s", "r", "a; b; b", "x"),
        (17, "s", "r", "1 2", "n"), (18, "s", "r", "12", "n"), (19, "s", "r", "x" * 200_000, "n"), (20, "s", "r", "X" * 200_000 + ".", "n"), (20, "s", "r", "X" * 200_000 + ".", "n"),
    ]
    got, df = groups(spark, rows)
    assert got == {(1, 2), (8, 10), (9, 11), (12, 13), (14, 15), (19, 20)}
    kept = {r["triple_id"]: r["n_copies"] for r in copies.collapsed(df, copies.members(df, **KEY), "triple_id").collect()}
    assert kept[1] == 2 and kept[3] == 1 and 2 not in kept and len(kept) == 20 - 6


def test_copies_of_nothing_and_a_hot_group(spark):
    assert groups(spark, [])[0] == set()
    got, _ = groups(spark, [(i, "s", "r", "Hot", "t") for i in range(300)] + [(1000 + i, "s", "r", f"cold {i} x", "t") for i in range(50)])
    assert got == {(0, i) for i in range(1, 300)}


def test_collisions_are_grouped_by_their_fields(spark, monkeypatch):
    monkeypatch.setattr(copies, "multiset_hash", lambda column, pieces, seed: F.lit(1))
    assert groups(spark, [(1, "s", "r", "a", "b"), (2, "s", "r", "c", "b"), (3, "s", "r", "C", "b"), (4, "s", "r", "A!", "b")])[0] == {(1, 4), (2, 3)}


def near_brute(left, right, tol):
    out = set()
    for e, i, t in left:
        c = [(abs(t - u), u, j) for f, j, u in right if f == e and e is not None and t is not None and u is not None and abs(t - u) <= tol]
        if c:
            out.add((i, min(c)[2]))
    return out


@pytest.mark.parametrize("n, scale, base, tol, hot", [(0, 2000, 0.0, 12.0, 9), (60, 2000, 0.0, 12.0, 99), (60, 40_000, 1.7e9, 12.0, 3), (40, 9000, -500.0, 1500.0, 3), (40, 1e15, -3e14, 1e13, 99)])
def test_nearest(spark, tmp_path, monkeypatch, n, scale, base, tol, hot):
    monkeypatch.setattr(nearest, "HOT", hot)
    monkeypatch.setattr(nearest, "SLABS", 3)
    rng = random.Random(n)
    t = lambda: rng.choice([None, float("inf"), *[base + round(rng.random() * scale, 1) for _ in range(20)]])
    left = [(rng.choice(["a", "b", None]), f"u{i}", t()) for i in range(n)] + ([("a", "edge", base + 600.0), ("a", "edge", base + 600.0)] if n else [])
    right = [(rng.choice(["a", "b"]), f"s{i}", t()) for i in range(n)] + ([("a", "x", base + 600.0 - tol), ("a", "w", base + 600.0 + tol), ("a", "v", base + 600.0 - tol)] if n else [])
    schema = "sample_id string, id string, start_time double"
    spark.createDataFrame(left, schema).selectExpr("sample_id", "id uid", "start_time", "1 side", "2 stretch").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame(right, schema).selectExpr("sample_id", "id sid", "start_time").write.parquet(f"{tmp_path}/r")
    got = nearest.nearest(spark, (f"{tmp_path}/l", "uid", "start_time"), (f"{tmp_path}/r", "sid", "start_time"), "sample_id", tol).collect()
    finite = lambda rows: [r for r in rows if r[2] != float("inf")]
    assert {(r["left_id"], r["right_id"]) for r in got} == near_brute(finite(left), finite(right), tol)


TRIPLES = "triple_id bigint, sample_id string, signal_source string, weight double, provenance array<struct<similarity_score:double>>, tier string, rrf string"


def test_fusion(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, float("nan"), rng.randrange(5) * 1.0, rng.random() * 900]), [(rng.choice([None, rng.random()]),) for _ in range(rng.randrange(3))], rng.choice(["Strong ", "MEDIUM", "weak", None])) for i in range(200)]
    got = {r["triple_id"]: r for r in fusion.ranked(spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], TRIPLES)).collect()}
    ok = lambda w: w is not None and w == w
    scale = {s: [r[3] for r in rows if r[2] == s and ok(r[3])] for s in ("x", "y", None)}
    stand = {}
    for r in rows:
        sims = [s[0] for s in r[4] if s[0] is not None]
        stand[r[0]] = (sum(w < r[3] for w in scale[r[2]]) / len(scale[r[2]]) if ok(r[3]) else -1, max(sims, default=-1), {"strong": 2, "medium": 1}.get((r[5] or "").strip().lower(), 0))
    assert len(got) == 200
    for r in rows:
        mates = [x[0] for x in rows if x[1] == r[1]]
        assert [got[r[0]][c] for c in ("weight_rank", "similarity_rank", "tier_rank")] == [1 + sum(stand[m][k] > stand[r[0]][k] for m in mates) for k in range(3)]
    assert fusion.top(spark.createDataFrame([], TRIPLES)).count() == 0
    wide = [-1e9, -700.0, -1.5, -1.0, -0.3, 0.0, 0.2, 1.0, 1.01, 5.0, 900.0, 1e12]
    b = [r["b"] for r in spark.createDataFrame([(v,) for v in wide], "v double").select("v", fusion.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert b == sorted(b) and len(set(b)) >= 11


def test_token_ids_against_a_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = encode.encoder(encode.VOCABULARY)
    ref = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|> it's", "héllo wörld 日本語 🙂🙂", "a" * 30_000, "\n\n  x", "\u0000​"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x460), rng.randrange(0x1F600, 0x1F640)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    assert [enc.encode(t) for t in texts] == [ref.encode_ordinary(t) for t in texts] and enc.encode(None) == []
    table = enc.table
    assert sorted(table.ids.tolist()) == sorted(enc.ranks.values()) and all(table.get(k) == v for k, v in list(enc.ranks.items())[::500]) and table.get(b"no such token, surely") == -1
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi", "z")], "doc_id bigint, text string, ids string")
    assert {r["doc_id"]: r["ids"] for r in encode.token_ids(df, "doc_id", "text").collect()} == {1: [], 2: [], 3: ref.encode_ordinary("hi")}


RIGHT = ["Während des Vortrags wäre die Prüfgröße müßig.", "La medición añadió ¿qué? señales más rápidas.", "Où la méthode échoue, l’exposé « déjà » fini.", "INFORMAÇÃO: a média não é SÃO MÃOS.", "Её проверка — «ИТОГ» см. № 4.", "Score → ∑ᵢ wᵢ·xᵢ ≤ √π 🙂", "20 °C ±2% €5 £3", "演讲内容很短 発表", "plain ascii"]


@pytest.mark.parametrize("legacy", ["cp1252", "latin-1", "iso8859_15", "cp1251", "mac_roman", "cp437", "cp850"])
def test_wrong_decodings_round_trip(legacy):
    for text in RIGHT[:4]:
        wrong = text.encode().decode(legacy, "ignore")
        if wrong.encode(legacy) == text.encode():
            hit, new, whole = mojibake.restore(wrong)
            assert hit and new == text, (legacy, wrong, new)
    assert [t for t in RIGHT if mojibake.restore(t)[0]] == []


def test_wrong_decodings_more():
    twice = "café naïve é".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.restore(twice)[:2] == (True, "café naïve é")
    ru = "После доклада проверка устойчива. Мы сравнили варианты."
    assert mojibake.restore(ru.encode("cp1251").decode("latin-1"))[:2] == (True, ru)
    assert mojibake.restore(ru.encode().decode("cp1252", "replace"))[0] and not mojibake.restore("a�b")[2]
    assert [mojibake.restore(t)[0] for t in (None, "", "   ", "x" * 300_000)] == [False] * 4
    for t in ("ÀÁÂ and ÄÖÜ", "the xдx variable", "ÀÁÂÃÄÅ ÆÇÈÉÊË ÌÍÎÏÐÑ", "НАБОР Iй", "αβγ δεζ", "Ünï ÇÖDË ÀÉÎÕÜ"):
        assert mojibake.restore(t) == (False, t, True), t
    often = "café naïve é"
    for _ in range(6):
        often = often.encode().decode("cp1252")
    assert mojibake.restore(often)[:2] == (True, "café naïve é")
    assert mojibake.restore(ru.encode("koi8-r").decode("latin-1"))[:2] == (True, ru) and mojibake.restore(ru.encode("koi8-r").decode("cp1251"))[1] == ru
    assert mojibake.restore("la naпveté du modиle")[1] == "la naïveté du modèle"


ITEM = "The sparse encoder raises recall on FooSet by nine points while the shared decoder keeps eleven frames per batch and drops the rest of them without any warm up at all today"


def leaked(*texts):
    return [bool(leaks.WuManber([(1, ITEM)]).leaked(t)) for t in texts]


def test_leaks():
    w = ITEM.split()
    slip = ITEM.replace("sparse", "spasre").replace("decoder", "decodder")
    assert leaked(ITEM, f"intro words {ITEM.upper()}, more.", slip, " ".join(w[:13]) + " other text here " + " ".join(w[18:])) == [True] * 4
    assert leaked("", " ".join(w[:9]), " ".join(w[:8] + ["x"] + w[9:14]), " ".join(w[:9]) + " z" * 200 + " " + " ".join(w[20:29])) == [False] * 4
    brute = {i for i in range(len(w) - 12) if leaked(" ".join(w[i : i + 13]))[0]}
    assert brute == set(range(len(w) - 12))


def test_leaks_frame(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, ITEM, "a"), (2, None, "b"), (3, "", "c"), (4, "z " * 200_000 + ITEM, "d")], "doc_id bigint, text string, share string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (7, ITEM)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, 7), (4, 7)}
    named = items.selectExpr("concat('i', item_id) item_id", "text")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, "doc_id", "text", named, "item_id", "text").collect()} == {(1, "i7"), (4, "i7")}
    assert leaks.leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0
    assert leaks.leaks(docs.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


BASE = "How many points of recall at ten does FooSlice gain over BarMatch on BazPrime?"
SAME = [BASE.upper(), BASE.lower(), "According to the presentation: " + BASE, BASE + " Answer briefly.", "Over BarMatch on BazPrime, how many points of recall at ten does FooSlice gain?", BASE.replace("points", "ponits"), BASE.replace("How many", "How many more"), f"“{BASE}”", BASE + " (one sentence)"]
OTHER = [BASE.replace("FooSlice", "FooSpan"), BASE.replace("ten", "one"), BASE.replace("recall at ten", "edit similarity"), "How many points of recall at ten does BarMatch gain over FooSlice on BazPrime?", BASE.replace("BazPrime", "BazPrimo")]


def twin_keys(held, train, *args, **kw):
    return {(r["eval_key"], r["train_key"]) for r in overlaps.expanded(*overlaps.overlaps(held, train, *args, **kw)).collect()}


def test_overlaps(spark):
    s = "qa_id string, question string, eval_key string, cls string"
    more = [BASE.replace("does", "does really"), "So how many points of recall at ten did FooSlice actually gain over BarMatch on BazPrime?"]
    train = spark.createDataFrame([(f"t{i}", q, "x", "y") for i, q in enumerate(SAME + more + OTHER + [None, "", "x" * 100_000])] + [("t0", SAME[0], "x", "y")], s)
    held = spark.createDataFrame([("g", BASE, "x", "y"), ("h", None, "x", "y"), ("i", "", "x", "y"), ("j", BASE, "x", "y")], s)
    got = twin_keys(held, train, "qa_id", ["question"], question=True)
    assert got == {(k, f"t{i}") for i in range(len(SAME + more)) for k in "gj"} | {("i", f"t{len(SAME + more + OTHER) + 1}")}
    pairs, members, _ = overlaps.overlaps(held, train, "qa_id", ["question"], question=True)
    assert pairs.count() == len(SAME + more) + 1 and members.count() == 3
    assert twin_keys(held.where("false"), train, "qa_id", ["question"], question=True) == twin_keys(held, train.where("false"), "qa_id", ["question"], question=True) == set()


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_edges(spark, monkeypatch, most):
    monkeypatch.setattr(overlaps, "BROADCAST_BYTES", most)
    f = "method: FooNet; metric: recall; value: -1.5; setting: few-shot"
    rows = [("1", "r", f, "Slide 5"), ("2", "r", "value = -1.5|setting=few-shot|METHOD: foonet|metric: recal", "slide 5 "), ("3", "r", f, "Slide 6"), ("4", "q", f, "Slide 5"), ("5", "r", f.replace("-1.5", "1.5"), "Slide 5"), ("6", "r", None, "Slide 5")]
    t = spark.createDataFrame(rows, "k string, relation string, h string, t string")
    assert twin_keys(t.where("k = '1'"), t.where("k <> '1'"), "k", ["h", "t"], group="relation") == {("1", "2")}


def slipped(rng, text, n=1):
    """A text with one letter changed, dropped, doubled or swapped with the next, in each of n words of letters alone."""
    ws = text.split()
    for i in rng.sample([i for i, w in enumerate(ws) if w.isalpha() and len(w) >= 5 and w.islower()], n):
        w, p = ws[i], rng.randrange(len(ws[i]) - 1)
        ws[i] = rng.choice([w[:p] + rng.choice("aeknrst") + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + w[p] + w[p:], w[:p] + w[p + 1] + w[p] + w[p + 2 :]])
    return " ".join(ws)


def test_segments_find_what_brute_force_finds(spark):
    rng = random.Random(2)
    vocabulary = ["sparse", "dense", "encoder", "decoder", "speaker", "annotators", "shrinks", "steadily", "recordings", "overlap"]
    make = lambda: " ".join([rng.choice(vocabulary) for _ in range(7)] + [rng.choice(["FooNet", "BarNet", "7", "8", "plain"])])
    evals = [(f"e{i}", make()) for i in range(60)]
    near = [slipped(rng, rng.choice(evals)[1], 2) for _ in range(60)]
    train = [(f"t{i}", t) for i, t in enumerate(near + [make() for _ in range(200)])]
    got = twin_keys(spark.createDataFrame(evals, "k string, t string"), spark.createDataFrame(train, "k string, t string"), "k", ["t"])
    want = {(a, b) for a, x in evals for b, y in train if overlaps.agree(overlaps.Canonical(x, False), overlaps.Canonical(y, False), False)}
    assert got == want and len({b for _, b in want}) >= 50


def test_slips_that_were_not_planted(spark):
    """Recall of one to three random edits, each in another of our own words, against all pairs known."""
    rng = random.Random(8)
    pool = "layered narrow faithful noisy gentle parser reader ranker summary corpus margin benefit decline venue lecture chapter figure margins reports explains loses keeps favours questions audience".split()
    name = lambda: rng.choice(["Kilo", "Lima", "Mika", "Nova", "Opal"]) + rng.choice(["Bank", "Deck", "Farm", "Gate"]) + rng.choice(["", "Two", "Max"])
    held = [(f"e{i}", f"{name()} {' '.join(rng.sample(pool, rng.randrange(6, 11)))} {rng.randrange(90)} {rng.choice(pool)}") for i in range(300)]
    train = [(f"t{i}", slipped(rng, t, 1 + i % 3)) for i, (_, t) in enumerate(held)]
    got = twin_keys(spark.createDataFrame(held, "k string, t string"), spark.createDataFrame(train, "k string, t string"), "k", ["t"])
    assert sum((f"e{i}", f"t{i}") in got for i in range(300)) >= 285 and len(got) <= 300


@pytest.mark.parametrize("n", range(3))
def test_banded(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(9)))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(2000):
        a, b, most = word(), word(), rng.randrange(6)
        assert overlaps.banded(a, b, most) == (edits(a, b) <= most), (a, b, most)


PAGES = [
    ("a", "FooTalk: sparse encoder for slide retrieval\nThe dense workload was mea-\nsured twice on ten recordings.\n3", 3), ("b", "FOOTALK: SPARSE ENCODER FOR SLIDE RETRIEVAL | 4\nThe dense vvorkload was measured with mixed-\nprecision weights.", 4),
    ("c", "1 Related work\n- Most mixed-precision recordings were measured twice\n- The workload is dense.", 5), ("d", "*FooTalk: sparse encoder for slide retrieva1*\nThe workl0ad is dense and mea¬\nsured.\nPage 6 of 9", 6),
]


def test_scans(spark):
    filler = [(f"f{i}", f"The workload {i} was measured with mixed-precision weights.", 1) for i in range(12)]
    rows = [("t", k, "s", p, x, "z") for k, x, p in PAGES + filler] + [("t", "n", "s", None, None, "z"), ("t", "e", None, 1, " ", "z"), ("t", "long", "s", 1, "word " * 60_000, "z"), ("t", "a", "s", 3, PAGES[0][1], "z")]
    got = {r["row_key"]: r for r in scans.cleaned(spark.createDataFrame(rows, "source_table string, row_key string, session string, page int, text string, rid string")).collect()}
    assert set(got["a"]["noise"]) == {"header", "hyphenation", "page_number"} and got["a"]["clean_text"] == "The dense workload was measured twice on ten recordings."
    assert set(got["b"]["noise"]) == {"header", "misread", "page_number"} and "workload was measured with mixed-precision weights" in got["b"]["clean_text"]
    assert got["c"]["noise"] == [] and got["c"]["clean_text"].count("\n") == 2
    assert set(got["d"]["noise"]) == {"header", "misread", "hyphenation", "page_number"} and got["d"]["clean_text"] == "The workload is dense and measured."
    assert got["n"]["noise"] == [] and got["n"]["clean_text"] is None and got["e"]["noise"] == [] and got["long"]["noise"] == [] and len(got) == 19


def qa(n):
    rng = random.Random(n)
    name = lambda: rng.choice(["Foo", "Bar", "Baz", "Qux"]) + rng.choice(["Net", "Mix", "Cue", "Tree"])
    q = [lambda a, b: (f"Which metric is reported for {a} in the full-data setting on {b}?", f"The metric reported for {a} in the full-data setting is edit similarity, averaged over {rng.randrange(99)} passages."),
         lambda a, b: (f"Welche Auswertung nutzt {a} für die Wörter in {b}?", f"{a} nutzt eine kürzere Auswertung, die auf {rng.randrange(99)} Wörter geprüft wurde und um 2.1 Punkte zulegt."),
         lambda a, b: (f"What limitation of {a} does the speaker mention for table parsing?", f"{a} cannot handle layered tables on a single card, so the speaker advises against it for table parsing.")]
    return [rng.choice(q)(name(), name()) for _ in range(n)]


def test_pairs_held_out():
    crf = pairs.trained(qa(150))
    judge = lambda q, a, known=9, longer=None: pairs.defect(crf, q, a, known, known, [longer])
    for q, a in qa(40)[::2]:
        other = "The talk reports a rather different result which was checked on the slides." if q.startswith("Welche") else "Das Verfahren nutzt eine kürzere Auswertung, die auf 12 Wörter geprüft wurde und nicht zulegt."
        assert judge(q, a) is None and judge(q, "Unfortunately the talk is brief here, but " + a) is None
        assert judge(q, q) == judge(q, q.lower().rstrip("?") + ".") == judge(q, f"Question: {q} Answer:") == "copies_question"
        assert judge(q, "I am sorry, but I cannot answer this from the given context.") == "refusal"
        assert judge(q, other) == "wrong_language"
        assert judge(q, a[: int(len(a) * 0.7)].rsplit(" ", 1)[0] + " of the") == "truncated" and judge(q, a[: int(len(a) * 0.6)] + "xq", 0) == "truncated"
    assert [judge("Q?", a) for a in (None, "", "  ", "...", "N/A", "null", '""')] == ["empty_answer"] * 7
    assert judge(None, "A plain answer.") is None


def test_pairs_frame(spark):
    rows = [(i, q, q, a, a, None) for i, (q, a) in enumerate(qa(60))]
    rows += [(100, "z", qa(1)[0][0], None, "Sorry, I cannot answer this question.", (True,)), (101, "z", qa(1)[0][0], "x " * 50_000, None, (True,)), (102, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[-1:], "result_id bigint, sample_id string, question string, ground_truth_answer string, generated_answer string, llm_evaluation struct<is_unanswerable:boolean>").withColumn("last", F.lit(1)).withColumn("longest", F.lit(2))
    got = {(r["result_id"], r["answer_field"], r["defect"]) for r in pairs.defects(df).collect()}
    assert {x for x in got if x[0] < 100} == set()
    assert (101, "generated_answer", "empty_answer") in got and (102, "ground_truth_answer", "empty_answer") in got and not [x for x in got if x[0] == 100]
    assert pairs.defects(df.where("false")).count() == 0


def test_wrong_decodings_frame(spark):
    wrong = "cafÃ© naÃ¯ve"
    df = spark.createDataFrame([(1, wrong, "x", True), (1, wrong, "x", True), (2, None, "x", True), (3, "", "x", True), (4, "plain", "x", True), (5, "x " * 100_000 + wrong, "x", True)], "doc_id bigint, text string, restored string, whole boolean")
    got = {r["doc_id"]: (r["restored"][-10:], r["whole"]) for r in mojibake.restored(df, "doc_id", "text").collect()}
    assert got == {1: ("café naïve", True), 5: ("café naïve", True)}
    assert mojibake.restored(df.where("false"), "doc_id", "text").count() == 0


def test_scans_and_tokens_of_nothing(spark):
    none = spark.createDataFrame([], "source_table string, row_key string, session string, page int, text string")
    assert scans.cleaned(none).count() == 0
    assert encode.token_ids(none.selectExpr("row_key doc_id", "text"), "doc_id", "text").count() == 0


def test_leaks_around_stock():
    stock = "in the low light recordings one listener asked whether the"
    item = lambda i: [f"a{i}x{k}" for k in range(22)] + stock.split() + [f"b{i}x{k}" for k in range(22)]
    w = item(0)
    search = leaks.WuManber([(i, " ".join(item(i))) for i in range(6)])
    assert search.leaked(" ".join(w[16:40])) == {0: 24 / 54}
    assert search.leaked(stock + " z " + stock) == {}
    assert search.leaked(" ".join(w[:12]) + " z " + stock) == {}
    assert leaks.WuManber([(i, " ".join(item(0))) for i in range(5)]).leaked(" ".join(w)) == dict.fromkeys(range(5), 1.0)
    mixed = [[f"c{i}"] + [f"p{k // 4 * 4}q{k % 4}" for k in range(i % 2 * 4, i % 2 * 4 + 4)] * 3 for i in range(10)]
    assert set(leaks.WuManber([(i, " ".join(m)) for i, m in enumerate(mixed)] + [(99, "p0q0 p0q1 p0q2 p0q3 p4q0 p4q1 p4q2 p4q3 end")]).leaked("p0q0 p0q1 p0q2 p0q3 p4q0 p4q1 p4q2 p4q3 end")) >= {99}


def test_leaks_of_equal_short_and_unspaced_items():
    near = [ITEM, ITEM.replace("nine", "ten"), ITEM.replace("nine", "six"), ITEM.replace("nine", "two")]
    for n in (1, 3, 10):
        assert leaks.WuManber([(i, ITEM) for i in range(n)]).leaked(ITEM) == dict.fromkeys(range(n), 1.0)
    assert set(leaks.WuManber(list(enumerate(near))).leaked(" ".join(ITEM.split()[12:]))) == set(range(4))
    chinese = "演讲者比较了两种编码器在幻灯片检索中的召回率并说明了原因"
    search = leaks.WuManber([(1, chinese), (2, "seven frames a batch suffice"), (3, "FooSet"), (4, "...")])
    assert set(search.leaked(f"上文{chinese}。下文")) == set(search.leaked(f"上文{chinese[3:17]}。下文")) == {1} and search.leaked(chinese[:8]) == {}
    assert set(search.leaked("Here, seven frames a batch suffice.")) == {2} and search.leaked("seven frames a batch") == {} and set(search.leaked("on fooset")) == {3}


def test_languages():
    spoken = {
        "zh": "演讲者没有说明使用了哪个数据集", "ja": "この発表では新しい手法を提案します", "nl": "De spreker zegt dat het model niet beter is dan de basis", "pl": "Nie ma wyniku dla tej metody, ponieważ jest on w innej pracy",
        "tr": "Bu çalışma için daha çok veri var ve sonuç değil", "en": "The speaker reports the error of the model", "de": "Das Verfahren nutzt eine kürzere Auswertung und ist nicht neu", "fr": "La méthode utilise une mesure plus courte dans le cadre",
        "es": "El método usa una medida más corta según la charla", "ru": "Метод улучшает оценку на два пункта", "ko": "발표자는 새로운 방법을 제안합니다", "": "FooNet 12.5",
    }
    assert {c: pairs.language(t) for c, t in spoken.items()} == {c: c for c in spoken}
    crf = pairs.trained(qa(150))
    q, a = qa(1)[0][0], "Which metric is reported for FooNet in the full-data setting?"
    assert [pairs.defect(crf, a, spoken[c] + ".", 9, 9, [None]) for c in ("zh", "ja", "nl", "pl", "tr", "ko")] == ["wrong_language"] * 6
    assert pairs.language("x" * 300_000) == ""


def test_pieces_of_words(spark):
    """Whether a last word is a piece doesn't turn on how large the table is."""
    s = "result_id bigint, sample_id string, question string, ground_truth_answer string, generated_answer string, llm_evaluation struct<is_unanswerable:boolean>"
    q = "Which part of the talk covers the measured latency?"
    base = [(i, f"s{i}", q, f"The talk covers measured latency number {i} in the second part of the recording.", f"The second part number {i} covers it, with all of the recording.", None) for i in range(40)]
    cut = [(100, "z", q, "The talk covers it in the second part of the recording.", "The talk covers it all in the second part of the recordi", None), (101, "y", q, "The talk covers it in the second part of the recording.", "It is all in the second part of the recording", None)]
    for n in (1, 20):
        rows = cut + [(i + 1000 * k, f"{sid}-{k}", *rest) for k in range(n) for i, sid, *rest in base]
        got = {(r["result_id"], r["defect"]) for r in pairs.defects(spark.createDataFrame(rows, s)).where("result_id in (100, 101)").collect()}
        assert got == {(100, "truncated")}, (n, got)


def test_headers_that_lost_letters_and_numbers_in_sequence(spark):
    head = "KiloBank: layered reader for lecture summaries"
    damaged = [head, head.replace("layered", "layred"), head.replace("summaries", "sumaries"), f"confname 2031, {head}", head.replace("reader", "reder"), head + " 7"]
    body = "The narrow parser was compared\n{n}\nwith faithful rankers, and the margin of chapter {w} fell."
    words = ["one", "two", "three", "four", "five", "six"]
    rows = [("t", f"k{i}", "s", i + 1, f"{h}\n" + body.format(n=i + 101, w=words[i]), "z") for i, h in enumerate(damaged)]
    rows += [("t", "other", "s", 9, "Some lines of text stand here\n640\nand the rest of it follows.", "z")]
    got = {r["row_key"]: r for r in scans.cleaned(spark.createDataFrame(rows, "source_table string, row_key string, session string, page int, text string, i string")).collect()}
    assert all({"header", "page_number"} <= set(got[f"k{i}"]["noise"]) for i in range(6)) and got["other"]["noise"] == []
    assert all(got[f"k{i}"]["clean_text"] == f"The narrow parser was compared with faithful rankers, and the margin of chapter {words[i]} fell." for i in range(6))


def test_pairs_of_other_wordings():
    crf = pairs.trained(qa(150))
    judge = lambda q, a: pairs.defect(crf, q, a, 9, 9, [None])
    refusals = ["I'd rather not say, as the slides leave that out.", "This can't be answered from what we have.", "No information about this is provided.", "The answer isn't given anywhere in the context.", "Es ist nicht möglich, das zu beantworten.", "We cannot determine this."]
    for i, (q, _) in enumerate(qa(60)):
        assert judge(q, refusals[i % len(refusals)]) == "refusal" and judge(q, "So you want to know: " + q) == "copies_question"
        assert judge(q, "演讲者比较了两种方法并给出了结果。") == judge(q, "De methode gebruikt een maat die niet langer is dan de proef.") == "wrong_language"


def test_leaks_of_other_texts():
    rng = random.Random(5)
    pool = "gentle parser reader ranker summary corpus margin benefit decline venue lecture chapter figure reports explains loses keeps favours question audience narrow faithful noisy".split()
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.randrange(30, 80))) for i in range(80)]
    search = leaks.WuManber(items)
    part = lambda t: " ".join(t.split()[: max(13, round(0.6 * len(t.split())))])
    assert all(i in search.leaked(f"{say(50)}. {slipped(rng, part(t))}. {say(50)}") for i, t in items)
    assert not any(search.leaked(say(300)) for _ in range(40))
