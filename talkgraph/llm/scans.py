"""Text of scanned pages made readable: running headers, page numbers, hyphenation and misread letters.

Headers and footers are lines that recur, but for page numbers, letter case, marks, misread letters and a few
lost or added ones, at the page edges of their session; lone page numbers are told by their form and place, or
by the session's sequence, in which they keep their distance from the pages. The words of
all pages are counted: a word broken over two lines is joined unless the corpus knows it with its hyphen, and
a word is misread if common confusions of letters turn a much more frequent word into it. What is left is
joined into paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

#: Lines at the top and at the bottom of a page, page numbers aside, that count as its edges; for a bare page number, those within EDGE lines.
HEAD_EDGE, EDGE = 1, 2
#: Words of a header at least, and pages of the session that have to show it.
HEADER_WORDS, HEADER_PAGES = 4, 2
#: Two header lines are one if they begin or end with the same PINNED words and differ in this share of their letters, or, with LONG words at least, in EXTRA words before or after, at most.
PINNED, LOOSE, EXTRA, LONG = 3, 0.1, 2, 6
#: Share of a session's edge lines that a header has which lines are compared with like that.
OFTEN = 0.01
#: Pages of a session on which printed numbers have to keep one distance from the page.
SEQUENCE = 3
#: How much more frequent the right word is than its misread form: of letters alone, and with foreign signs in it.
RATIO, RATIO_SIGNS = 8, 1
#: Letters and what they are taken for (fixed values).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("s", "5"), ("i", "l"), ("i", "1"), ("ti", "fi"), ("o", "0"), ("l", "1"), ("d", "cl"), ("cl", "d"), ("m", "rn"), ("u", "ii"),
    ("g", "q"), ("g", "9"), ("h", "b"), ("y", "v"), ("b", "6"), ("li", "h"), ("w", "vv"), ("z", "2"), ("s", "$"), ("t", "+"), ("l", "|"), ("i", "!"),
)
#: Words that come and go in running headers (fixed values).
FURNITURE = frozenset("page p pp vol no proceedings preprint draft".split())
#: Marks of a broken word; all but the first are never part of one.
MARKS = "-‐¬­"

_TOKEN = re.compile(r"[^\W_]+(?:[@$|!+][^\W_]+)*|[^\W_]*[@$|!+][^\W_]+(?:[@$|!+][^\W_]+)*")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W_]+)+")
_LINE = re.compile(r"\r\n|[\n\r\v\f  ]")
_BREAK = re.compile(r"([^\W\d_][^\W_@$|!+]*?|[^\W_]*[@$|!+]?[^\W_]*)([-‐¬­])[ \t]*$")
_HEAD = re.compile(r"[^\W_@]*[@$|!+]?[^\W_]+")
_ALONE = re.compile(r"\W*?(?:(page|p\.?|pg\.?|seite|página|стр\.?)\s*)?(\d{1,7})(?:\s*(?:of|/|von|sur|de)\s*\d{1,7})?\W*", re.I)
_LISTED = re.compile(r"\s*(?:[-•*–·▪◦]\s|\d{1,3}[.)]\s|\(?[a-z]\)\s)")
_HEADING = re.compile(r"\s*\d{1,2}(?:\.\d{1,2})*\s+[A-Z][\w ]{2,40}$")
_NUMBER_FIRST, _NUMBER_LAST = re.compile(r"^\W*?(\d{1,7})(?:\s*[|·]\s*|\s{2,}|\t|\s+)(?=\S)"), re.compile(r"(?:\s*[|·]\s*|\s{2,}|\t|\s+)(?:p\.?\s*|page\s*)?(\d{1,7})\W*$", re.I)


#: Single signs that are taken for each other, and the one that stands for them.
_FROM, _TO = "c5@0q96bv2$+|!1i", "esaogghhyzstllll"


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """One spelling for all words that the confusions can turn into each other."""
    w = word.lower().translate(str.maketrans(_FROM, _TO))
    w = w.replace("yy", "w").replace("rn", "m").replace("ll", "h").replace("el", "d").replace("f", "t").replace("u", "h")
    return w


def derived(right: str, seen: str) -> list[tuple[int, int, str]] | None:
    """How confusions turn ``right`` into ``seen``: (from, to, right letters) of each changed stretch of
    ``seen``; null if they can't or nothing is changed."""
    n, m = len(right), len(seen)
    stack: list[tuple[int, int, tuple]] = [(0, 0, ())]
    best, seen_states = None, set()
    while stack:
        i, j, changed = stack.pop()
        if i == n and j == m:
            if changed and (best is None or len(changed) < len(best)):
                best = changed
            continue
        if (i, j, len(changed)) in seen_states or len(changed) > 1 + n // 3:
            continue
        seen_states.add((i, j, len(changed)))
        for a, b in CONFUSIONS:
            if right.startswith(a, i) and seen.startswith(b, j):
                stack.append((i + len(a), j + len(b), (*changed, (j, j + len(b), a))))
        if i < n and j < m and right[i] == seen[j]:
            stack.append((i + 1, j + 1, changed))
    return list(best) if best else None


def misread_of(words: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(seen, right) among words of one fold; the most frequent right word wins."""
    words = sorted(words, key=lambda x: (-x[1], x[0]))
    out = []
    for seen, n in words[1:]:
        ratio = RATIO_SIGNS if re.search(r"[\d@$|!+]", seen) and re.search(r"[^\W\d_]", seen) else RATIO
        if len(seen) < 3 and ratio == RATIO:
            continue
        for right, most in words:
            if most < ratio * n or (most == n and ratio == RATIO):
                break
            if right != seen and not re.search(r"[\d@$|!+]", right) and derived(right, seen):
                out.append((seen, right))
                break
    return out


def repaired(token: str, right: str) -> str:
    """The token with its misread letters replaced, its letter case kept."""
    at, parts = 0, []
    for i, j, a in derived(right, token.lower()) or []:
        parts += [token[at:i], a.upper() if token[i:j].isupper() or (token.isupper() and len(token) > 1) else a.capitalize() if i == 0 and token[:1].isupper() else a]
        at = j
    return "".join(parts) + token[at:]


def lines_of(text: str) -> list[str]:
    return _LINE.split(text)


def header_key(line: str) -> str:
    """A line without page numbers, marks, letter case and misread letters."""
    words = [w for w in _TOKEN.findall(line.lower()) if not w.isdigit()]
    return " ".join(fold(w) for w in words if w not in FURNITURE)


def page_number(line: str, place: str, page: int | None) -> bool:
    """Whether a line is nothing but a printed page number. A bare number inside the page has to be the page's own, give or take one, or what its number ends in."""
    m = _ALONE.fullmatch(line.strip())
    if not m or len(line.strip()) > 24 or "%" in line or re.search(r"\d[.,]\d|\d\W*$(?<=[.;,])", line.strip()):
        return False
    dressed = m[1] or re.fullmatch(r"\[\d+\]|[-–—]\s*\d+\s*[-–—]", line.strip())
    return bool(dressed) or place == "edge" or (page is not None and (abs(int(m[2]) - page) <= 1 or str(page).endswith(m[2])))


def features(text: str, page: int | None) -> tuple[list[str], list[tuple[int, str, bool, bool]], list[tuple[int, str, str, str]], list[int], list[tuple[int, int]]]:
    """(distinct words, (line, key, at an edge, stands by itself), (line, left, right, mark) of breaks, page-number lines, (line, number) of lone numbers)."""
    lines = lines_of(text)
    full = [i for i, x in enumerate(lines) if x.strip()]
    edge = {*full[:EDGE], *full[-EDGE:]}
    numbers = [i for i in full if page_number(lines[i], "edge" if i in (full[0], full[-1]) or i in edge and len(full) > 2 * EDGE else "inside", page)] if len(full) > 1 else []
    alone = [(i, int(m[2])) for i in full if len(full) > 1 and len(lines[i]) <= 24 and (m := _ALONE.fullmatch(lines[i].strip())) and (i in numbers or lines[i].strip().isdigit())]
    body = [i for i in full if i not in numbers]
    ends = {*body[:HEAD_EDGE], *body[-HEAD_EDGE:]}
    words: set[str] = set()
    keys, breaks, skip = [], [], {}
    for k, i in enumerate(body):
        line = lines[i]
        after = lines[body[k + 1]] if k + 1 < len(body) else ""
        tail = line.rstrip(" \t")
        m = _BREAK.search(tail) if tail[-1:] and tail[-1] in MARKS else None
        if m and m[1] and (h := _HEAD.match(after.lstrip())) and h[0][:1].isalpha() | (h[0][:1] in "@015"):
            left, right = m[1].lower(), h[0].lower()
            breaks.append((i, left, right, m[2]))
            words.add(left + right)
            skip[i], skip[body[k + 1]] = (len(line) - len(m[1]) - 1, *skip.get(i, (0, 0))[1:]), (10**9, len(after) - len(after.lstrip()) + len(h[0]))
        clean = line.strip().strip("*_ \t")
        key = header_key(line)
        if key.count(" ") + 1 >= HEADER_WORDS and not _LISTED.match(line.replace("*", " ", 1) if line.lstrip().startswith("*") and not line.lstrip().startswith("* ") else line) and not re.search(r"[.!?;,:]$|[-‐¬­]$|[.;!?]\s+\w", clean):
            before = lines[body[k - 1]].strip() if k else ""
            lower = after.lstrip()[:1].islower()
            own = not lower if k == 0 or (k == 1 and not clean[:1].islower()) else not clean[:1].islower() or before[-1:] in ".!?:;%”\"" or not before
            keys.append((i, key, i in ends, bool(own)))
    for i in body:
        stop, start = (*skip.get(i, (10**9, 0)), 0)[:2]
        part = lines[i][start:stop] if i in skip else lines[i]
        words.update(w for w in (x.lower() for x in _TOKEN.findall(part)) if not w.isdigit())
        if "-" in part:
            words.update(x.lower() for x in _COMPOUND.findall(part))
    return sorted(words), keys, breaks, numbers, alone


_FEATURES = """source_table string, row_key string, session string, page int, text string, words array<string>,
lines array<struct<i:int,key:string,edge:boolean,own:boolean>>, breaks array<struct<i:int,left:string,right:string,mark:string>>, numbers array<int>, alone array<struct<i:int,n:int>>"""


_FIELDS = {"words": None, "lines": ("i", "key", "edge", "own"), "breaks": ("i", "left", "right", "mark"), "numbers": None, "alone": ("i", "n")}


def _featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        got = [features(t, None if p is None or p != p else int(p)) for t, p in zip(part["text"], part["page"])]
        for k, (c, fields) in enumerate(_FIELDS.items()):
            part[c] = [x[k] if fields is None else [dict(zip(fields, y)) for y in x[k]] for x in got]
        yield part


def header_keys(at: DataFrame) -> DataFrame:
    """(session, key) of the running headers among lines (session, key, edge, own): keys that recur in their session and
    stand at a page edge, those that do so counted together with keys that are near them, and keys near one of these.
    Near keys count only for lines that are often at the session's edges, as a long session has like lines by chance."""
    keys = at.groupBy("session", "key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("n_own"), F.sum(F.col("edge").cast("int")).alias("n_edge"))
    keys = written(keys, "scan-keys")
    pins = lambda df: df.withColumn("pin", F.explode(F.array(F.xxhash64("session", F.lit(0), F.substring_index("key", " ", PINNED)), F.xxhash64("session", F.lit(1), F.substring_index("key", " ", -PINNED)))))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    size = lambda c: F.size(F.split(c, " "))
    longer = (F.contains(padded("key"), padded("other")) | F.contains(padded("other"), padded("key"))) & (F.abs(size("key") - size("other")) <= EXTRA) & ((F.least(size("key"), size("other")) >= LONG) | (F.col("key") == F.col("other")))
    near = (F.levenshtein("key", "other", 12) >= 0) & (F.levenshtein("key", "other", 12) <= F.greatest(F.lit(1), F.floor(F.length("key") * LOOSE)))
    edge = keys.where("n_edge > 0")
    other = pins(edge).select("pin", F.col("session").alias("s2"), F.col("key").alias("other"), F.struct("n", "n_own", "n_edge").alias("c"))
    met = pins(edge.select("session", "key")).join(other, "pin").where(F.col("session").eqNullSafe(F.col("s2")) & (longer | near)).select("session", "key", "other", "c").distinct()
    sums = lambda p, when: [F.sum(F.when(when, F.col(f"c.{c}"))).alias(p + c) for c in ("n", "n_own", "n_edge")]
    total = met.groupBy("session", "key").agg(*sums("", F.lit(True)), *sums("c_", F.col("key") == F.col("other")))
    edges = edge.groupBy("session").agg(F.sum("n_edge").alias("edges"))
    recurs = lambda p: ((F.col(f"{p}n_edge") >= HEADER_PAGES) | (F.col(f"{p}n_edge") > 0) & (F.col(f"{p}n") > HEADER_PAGES)) & (F.col(f"{p}n_own") * 3 >= F.col(f"{p}n"))
    often = F.col("n_edge") >= F.greatest(F.lit(HEADER_PAGES), F.col("edges") * OFTEN)
    total = total.alias("t").join(edges.alias("e"), F.col("t.session").eqNullSafe(F.col("e.session"))).select("t.*", "edges").withColumn("often", often & recurs(""))
    heads = written(total.where(F.col("often") | recurs("c_")).select("session", "key", "often"), "scan-heads")
    loose = pins(keys.select("session", "key")).join(pins(heads).select("pin", F.col("session").alias("s2"), F.col("key").alias("other"), "often"), "pin").where(F.col("session").eqNullSafe(F.col("s2")) & F.col("often") & (longer | near))
    return heads.select("session", "key").union(loose.select("session", "key")).distinct()


def misreadings(vocabulary: DataFrame) -> DataFrame:
    """(seen, right) from (word, n): misread words with what they stand for."""
    folded = F.pandas_udf(lambda s: s.map(fold), "string")
    groups = vocabulary.where("not word like '%-%'").groupBy(folded("word").alias("f")).agg(F.collect_list(F.struct("word", "n")).alias("ws")).where(F.size("ws") > 1)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([x for ws in part["ws"] for x in misread_of([(w["word"], w["n"]) for w in ws])], columns=["seen", "right"])

    return groups.select("ws").mapInPandas(judge, "seen string, right string")


def assembled(text: str, headers: set[int], numbers: set[int], breaks: dict[int, str], fixes: dict[str, str]) -> str:
    """The clean text: header and number lines gone, broken words and misread letters mended, lines joined to paragraphs."""
    out, glue = [], ""
    lines = lines_of(text)
    for i, line in enumerate(lines):
        if i in headers or i in numbers:
            continue
        if not line.strip():
            out.append("")
            continue
        line = line.strip()
        joined = bool(glue)
        if glue == "join":
            out[-1] += line
        elif glue == "keep" or (out and out[-1] and not _LISTED.match(line) and not _HEADING.match(line) and not _HEADING.match(out[-1])):
            out[-1] += ("" if joined else " ") + line
        else:
            out.append(line)
        glue = breaks.get(i, "")
        if glue == "join":
            out[-1] = out[-1].rstrip()[:-1]
    clean = "\n".join(x for k, x in enumerate(out) if x or (k and out[k - 1]))
    if fixes:
        clean = _TOKEN.sub(lambda m: repaired(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], clean)
    return clean.strip()


def cleaned(records: DataFrame) -> DataFrame:
    """(source_table, row_key, clean_text, noise) of records (source_table, row_key, session, page, text).

    noise lists what was found: hyphenation, misread, header, page_number. Null, empty and blank texts have no
    noise and are returned as they are; rows repeated with the same text are one record; a text of one line
    has no page number. Nothing is looked at in part: every word and line of every text counts.
    """
    base = records.select("source_table", "row_key", "session", F.col("page").cast("int").alias("page"), "text").dropDuplicates(["source_table", "row_key", "text"])
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    feats = written(base.where(has).mapInPandas(_featured, _FEATURES).withColumn("rid", F.xxhash64("source_table", "row_key", "text")), "scan-features")
    vocabulary = written(feats.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "scan-words")
    # headers: every line that has a header's key
    at = feats.select("rid", "row_key", "session", F.explode("lines").alias("l")).select("rid", "row_key", "session", "l.*")
    a, k = at.alias("a"), header_keys(at).alias("k")
    mark = lambda df, kind, i="i", how=None, seen=None: df.select("rid", "row_key", F.lit(kind).alias("kind"), (F.lit(-1) if i is None else F.col(i)).alias("i"), F.lit(None).cast("string").alias("how") if how is None else how.alias("how"), F.lit(None).cast("string").alias("seen") if seen is None else F.col(seen).alias("seen"))
    headers = a.join(k, (F.col("a.session").eqNullSafe(F.col("k.session"))) & (F.col("a.key") == F.col("k.key"))).select("a.rid", "a.row_key", "a.i")
    # page numbers by the session's sequence
    lone = feats.where("page is not null").select("rid", "row_key", "source_table", F.coalesce("session", F.lit("")).alias("session"), "page", F.explode("alone").alias("l")).select("rid", "row_key", "source_table", "session", "page", "l.i", (F.col("l.n") - F.col("page")).alias("off"))
    runs = lone.groupBy("source_table", "session", "off").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= SEQUENCE).drop("pages")
    numbers = lone.join(runs, ["source_table", "session", "off"])
    # misread words
    wrong = misreadings(vocabulary)
    fixes = feats.select("rid", "row_key", F.explode("words").alias("seen")).join(wrong, "seen")
    # broken words: kept only if the corpus knows them with the hyphen
    br = feats.select("rid", "row_key", F.explode("breaks").alias("b")).select("rid", "row_key", "b.*", F.concat("b.left", F.lit("-"), "b.right").alias("comp"), F.concat("b.left", "b.right").alias("whole"))
    counts = vocabulary.select(F.col("word").alias("w"), F.col("n").alias("wn"))
    doubt = (
        br.where(F.col("mark") == "-").join(counts.withColumnRenamed("w", "comp").withColumnRenamed("wn", "n_comp"), "comp", "left")
        .join(counts.withColumnRenamed("w", "whole").withColumnRenamed("wn", "n_whole"), "whole", "left")
        .withColumn("how", F.when(F.coalesce("n_comp", F.lit(0)) > F.coalesce("n_whole", F.lit(0)), "keep").otherwise("join"))
    )
    sure = br.where(F.col("mark") != "-")
    # all marks of a text are one row before the texts are met
    marks = mark(headers, "header").union(mark(numbers, "number")).union(mark(fixes, "fix", None, F.col("right"), "seen")).union(mark(sure, "break", "i", F.lit("join"))).union(mark(doubt, "break", "i", F.col("how")))
    of = lambda kind, x: F.collect_set(F.when(F.col("kind") == kind, x))
    marks = marks.groupBy("rid", "row_key").agg(of("header", F.col("i")).alias("headers"), of("number", F.col("i")).alias("more"), of("fix", F.struct("seen", "how")).alias("fixes"), of("break", F.struct("i", "how")).alias("hows"))
    out = feats.select("rid", "source_table", "row_key", "text", "numbers").join(marks, ["rid", "row_key"], "left")
    made = out.withColumns({"fixes": F.map_from_entries("fixes"), "hows": F.map_from_entries("hows"), "numbers": F.array_union("numbers", F.coalesce("more", F.array().cast("array<int>")))}).mapInPandas(_assemble, "source_table string, row_key string, clean_text string, noise array<string>")
    none = F.array().cast("array<string>")
    return made.union(base.where(~has | F.col("text").isNull()).select("source_table", "row_key", F.col("text").alias("clean_text"), none))


def _assemble(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        texts, noises = [], []
        for text, numbers, headers, fixes, hows in zip(part["text"], part["numbers"], part["headers"], part["fixes"], part["hows"]):
            headers = set() if headers is None else set(headers.tolist() if hasattr(headers, "tolist") else headers)
            numbers, fixes, hows = set(list(numbers)), dict(fixes or {}), dict(hows or {})
            lines = lines_of(text)
            inside = any(_NUMBER_FIRST.search(lines[i]) or _NUMBER_LAST.search(lines[i].strip()) for i in headers)
            found = [
                ("hyphenation", any(h == "join" and i not in headers for i, h in hows.items())),
                ("misread", bool(fixes)), ("header", bool(headers)), ("page_number", bool(numbers) or inside),
            ]
            texts.append(assembled(text, headers, numbers, hows, fixes))
            noises.append([n for n, there in found if there])
        yield pd.DataFrame({"source_table": part["source_table"], "row_key": part["row_key"], "clean_text": texts, "noise": noises})


def page_of(id_col: str) -> Column:
    """The number at the end of a path-like id, null if there is none."""
    return F.regexp_extract(id_col, r"(\d{1,7})$", 1).try_cast("int")
