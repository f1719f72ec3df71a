"""Records of evaluation splits that recur, exactly or nearly, in the training split.

An edit-distance segment join. Texts are brought to canonical strings of words; of an evaluation string K + 1
segments, cut at word boundaries, are indexed, so that K slips leave at least one of them untouched in a training
twin. The rarest are taken; a name, which has to agree, is enough by itself. Words may be rearranged, so the
positions allowed are all beginnings of words; length and numbers have to fit, too. Evaluation segments and
training substrings meet in a shuffle join on their hash, and each pair found is verified: banded dynamic
programming over the two strings in the order written and in two sorted ones, then names, numbers and their order
or roles, and the slips word by word.

Copies are one class of texts on either side; classes are joined, and their members listed beside.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

#: Words of a text that a slip may have changed, for every so many words; at least MIN_K.
WORDS_PER_SLIP, MIN_K = 5, 3
#: Edits of a whole string: so many, and one more for every so many characters.
EDITS, CHARS_PER_EDIT = 3, 15
#: Evaluation segments go to every executor if they take no more than so many bytes, a row counting for ROW_BYTES; beyond that they are met by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 96

# Words that may come or go.
SMALL = frozenset(
    "a an the of in on at to for by is are was were be been do does did has have had and as that more please there very really quite just also then now so too actually exactly rather "
    "kindly well still even here any some this these those it its their our your can could would will may might shall should you me us we i".split()
)
# Words that ask or say the same.
ALIKE = (("which", "what"), ("speaker", "talk", "presenter"), ("aligned", "linked", "matched"), ("use", "employ", "utilise", "utilize", "apply"), ("reported", "given", "stated"))
# Words of lead-ins and of closing requests.
LEAD_IN = frozenset("a according answer at based briefly context from given here i in is me my of on paper please presentation q question quick session slides slide talk tell the this to us video".split())
CLOSING = frozenset("a answer as be brief briefly cite concise explain in keep of one only paper please possible reply sentence short slide slides source thank thanks the word words you your".split())

_SAME = {w: group[0] for group in ALIKE for w in group}
_TOKEN = re.compile(r"(?<![\w.])[-−–]?\.?\d+(?:[.,]\d+)*(?:\w+)?|[^\W_]+")
_WORD, _HUMP = re.compile(r"[^\W_]+"), re.compile(r"[a-zß-ÿ][A-Z]")
_WRAP = "\"'`*_“”„«»‘’()[]<> \t\r\n\xa0"


def near(a: str, b: str) -> bool:
    """Equal but for a slip of spelling: one edit, two in words of eight letters or more; a swap of neighbours is one.

    Dynamic programming over the band of two cells beside the diagonal.
    """
    n, m = len(a), len(b)
    if abs(n - m) > 2 or min(n, m) < 3:
        return a == b
    most = 2 if min(n, m) >= 8 else 1
    far = most + 1
    before: list[int] = []
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - 2), min(m, i + 2) + 1):
            cost = a[i - 1] != b[j - 1]
            x = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + cost)
            if cost and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            row[j] = min(x, far)
        before, last = last, row
    return last[m] <= most


def bare(text: str) -> str:
    """A question without its lead-in and closing request."""
    text = text.strip(_WRAP)
    for _ in range(2):
        m = re.match(r"\s*([^:,?]{1,60}?)\s*(?::|,|\s[-–—])\s*(?=\S)", text)
        if not m or not {w.lower() for w in _TOKEN.findall(m[1])} <= LEAD_IN:
            break
        text = text[m.end() :]
    m = re.search(r"[?.!]?\s*[(\[]([^()\[\]]{1,60})[)\]]?\s*$", text) or re.search(r"[?.!]\s*([^?.!]{1,60})[.!]?\s*$", text)
    if m and {w.lower() for w in _TOKEN.findall(m[1])} <= CLOSING:
        text = text[: m.start()]
    return text


def banded(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits turn one string into the other: dynamic programming over the band beside the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        n = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
        a, b = a[: len(a) - n], b[: len(b) - n]
    n, m, far = len(a), len(b), most + 1
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        row[0] = min(i, far)
        for j in range(lo, hi + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]), far)
        if min(row[lo - 1 : hi + 1]) > most:
            return False
        last = row
    return last[m] <= most


@lru_cache(maxsize=100_000)
def _small(w: str) -> bool:
    """Whether a word is a slip of a small one."""
    return len(w) > 3 and any(near(w, x) for x in SMALL)


class Canonical:
    """The words of a text that count, and which of them are names or numbers with the words before them."""

    __slots__ = ("bag", "names", "roles", "seq", "strings", "words")

    def __init__(self, text: str, question: bool) -> None:
        if question:
            text = bare(text)
        raw = _TOKEN.findall(text)
        cased = sum(map(str.isupper, raw)) * 2 <= len(raw)
        self.names = {w.lower() for w in _WORD.findall(text) if _HUMP.search(w)} if cased else set()
        low = [_SAME.get(w, w) for w in (self._number(x.lower()) for x in raw)]
        self.words = tuple(w for w in low if w not in SMALL)
        self.bag = Counter(self.words)
        self.seq = low
        self.roles: dict[str, list[str]] = defaultdict(list)
        for before, w in zip(["", *low], low):
            self.roles[w].append(before)
        self.strings = tuple(" ".join(sorted(self.words, key=k) if k else self.words) for k in (None, str, lambda w: w[::-1]))

    @staticmethod
    def _number(w: str) -> str:
        return w.replace("−", "-").replace("–", "-") if _numeric(w) else w


def agree(a: Canonical, b: Canonical, fields: bool) -> bool:
    """Whether two texts say the same about the same names and numbers."""
    left, right = list((a.bag - b.bag).elements()), list((b.bag - a.bag).elements())
    names = a.names | b.names
    if any(w in names or _numeric(w) for w in left + right):
        return False
    for w in list(left):
        twin = next((x for x in right if near(w, x)), None)
        if twin is not None:
            left.remove(w)
            right.remove(twin)
    if not all(map(_small, left + right)):
        return False
    most = EDITS + max(len(a.strings[0]), len(b.strings[0])) // CHARS_PER_EDIT
    if not any(banded(x, y, most) for x, y in zip(a.strings, b.strings)):
        return False
    if fields:
        return True
    fixed = lambda c: [w for w in c.seq if w in names or _numeric(w)]
    one, two = fixed(a), fixed(b)
    if one == two:
        return True
    return sorted(one) == sorted(two) and all(all(p == q or near(p, q) for p, q in zip(sorted(a.roles[w]), sorted(b.roles[w]))) for w in one if len(a.roles[w]) == len(b.roles[w]))


def parts_of(text: str | None) -> tuple[str, bool]:
    """A text and whether it is a list of fields, whose order doesn't matter."""
    text = text or ""
    return text, len(re.findall(r"[;|]", text)) >= 2


def _numeric(w: str) -> bool:
    return not w.isalpha() and any(c.isdigit() for c in w)


def _numbers(canon: list[Canonical]) -> tuple:
    """The numbers of a record, text by text."""
    return tuple(tuple(sorted(w for w in c.words if _numeric(w))) for c in canon)


def substrings(grp: str, texts: tuple[str, ...], question: bool) -> tuple[list[tuple[int, bool]], int, int]:
    """((hash, is a name) of the segments of a record, its slips allowed, its length). A hash stands for group, numbers, text and word; a record without words has one for all of that."""
    canon = [Canonical(t, question) for t in texts]
    numbers = _numbers(canon)
    of = lambda i, w: xxhash.xxh64_intdigest(repr((grp, numbers, i, w))) - (1 << 63)
    got = sorted((of(i, w), w in c.names) for i, c in enumerate(canon) for w in set(c.words) if not _numeric(w))
    total = sum(len(c.words) for c in canon)
    return got or [(of(-1, ""), False)], max(MIN_K, total // WORDS_PER_SLIP), sum(len(c.strings[0]) for c in canon)


@lru_cache(maxsize=20_000)
def _canonical(text: str, question: bool) -> Canonical:
    return Canonical(text, question)


def says_the_same(one: tuple[str, ...], other: tuple[str, ...], question: bool) -> bool:
    """Whether each text of one record says the same as the other record's."""
    return all(agree(_canonical(x, question), _canonical(y, question), parts_of(x)[1] and parts_of(y)[1]) for x, y in zip(one, other))


def classed(df: DataFrame, key: str, texts: list[str], group: str | None) -> DataFrame:
    """(cls, key, grp, t0, t1, ...) of the rows without a null; cls is one for all rows of the same group and texts."""
    g = F.col(group) if group else F.lit("")
    whole = df.select(F.col(key).cast("string").alias("key"), g.alias("grp"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(texts))).na.drop()
    return whole.withColumn("cls", F.unhex(F.md5(F.to_json(F.struct("grp", *(f"t{i}" for i in range(len(texts))))))))


def twins(held_out: DataFrame, train: DataFrame, n_texts: int, question: bool = False) -> DataFrame:
    """(eval_cls, train_cls) of classes whose texts each say the same, from classed() rows."""
    names = [f"t{i}" for i in range(n_texts)]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = lru_cache(maxsize=20_000)(lambda *x: substrings(x[0], x[1:], question))  # copies are often near one another
        for part in parts:
            got = [once(*x) for x in zip(part["grp"], *(part[c] for c in names))]
            yield pd.DataFrame({"cls": part["cls"], "segments": [[{"h": h, "name": n} for h, n in g[0]] for g in got], "k": [g[1] for g in got], "size": [g[2] for g in got]})

    def segments(df: DataFrame) -> DataFrame:
        made = df.select("cls", "grp", *names).mapInPandas(cut, "cls binary, segments array<struct<h:bigint,name:boolean>>, k int, size int")
        return made.select("cls", "k", "size", F.explode("segments").alias("s")).select("cls", "k", "size", "s.*")

    words = written(segments(held_out).distinct(), "overlap-words")
    counts = words.groupBy("h").agg(F.count("*").alias("n"))
    # the rarest name, or else the K + 1 rarest words
    rarest = Window.partitionBy("cls").orderBy(F.desc("name"), "n", "h")
    index = (
        words.join(counts, "h").withColumn("rk", F.row_number().over(rarest)).withColumn("named", F.max("name").over(Window.partitionBy("cls")))
        .where(F.when(F.col("named"), F.col("rk") == 1).otherwise(F.col("rk") <= F.col("k") + 1)).select("h", F.col("cls").alias("eval_cls"), F.col("size").alias("eval_size"))
    )
    index = written(index, "overlap-index")
    if index.count() * ROW_BYTES <= BROADCAST_BYTES:
        index = F.broadcast(index)
    most = EDITS * n_texts + F.greatest("size", "eval_size") / CHARS_PER_EDIT
    met = segments(train).select("h", F.col("cls").alias("train_cls"), "size").join(index, "h").where(F.abs(F.col("size") - F.col("eval_size")) <= most)
    met = written(met.select("eval_cls", "train_cls").distinct(), "overlap-met")
    # one text of each class that has met another
    side = lambda df, p: df.join(met.select(F.col(f"{p}_cls").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select(F.col("cls").alias(f"{p}_cls"), *(F.col(n).alias(f"{p}_{n}") for n in names))
    both = met.join(side(held_out, "eval"), "eval_cls").join(side(train, "train"), "train_cls")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            one, other = (zip(*(part[f"{p}_{n}"] for n in names)) for p in ("eval", "train"))
            same = [says_the_same(x, y, question) for x, y in zip(one, other)]
            yield part.loc[same, ["eval_cls", "train_cls"]]

    return both.mapInPandas(verify, "eval_cls binary, train_cls binary")


def overlaps(held_out: DataFrame, train: DataFrame, key: str, texts: list[str], group: str | None = None, question: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (eval_cls, train_cls), evaluation members (cls, key), training members) of records whose texts each say
    the same about the same names and numbers.

    Two texts say the same if they have the same words but for formatting, letter case, small words, words
    that ask the same, the order of words (names and numbers keeping their order or the word before them) and
    of fields, and spelling slips; of questions, also but for a lead-in or closing request. group, if given,
    has to be equal. Rows with a null in the key, the group or a text don't take part; texts without any word
    agree with one another; repeated rows give one result row, and an empty side gives an empty result. The pairs of
    classes and the members are linear in the rows; expanded() makes all pairs of keys of them.
    """
    held, own = (classed(df, key, texts, group) for df in (held_out, train))
    return twins(held, own, len(texts), question), held.select("cls", "key").distinct(), own.select("cls", "key").distinct()


def expanded(pairs: DataFrame, held_members: DataFrame, train_members: DataFrame) -> DataFrame:
    """(eval_key, train_key) of every pair of members."""
    e, t = held_members.toDF("eval_cls", "eval_key"), train_members.toDF("train_cls", "train_key")
    return pairs.join(e, "eval_cls").join(t, "train_cls").select("eval_key", "train_key")
