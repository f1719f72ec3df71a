"""Held-out passages inside a corpus: Wu-Manber search over words, then runs and their coverage.

A text is the sequence of its words (letters and digits, lower case; in scripts without spaces every character
is one). Patterns are the SEED-word windows of all items, and whole items of fewer words. As in Wu and Manber's search, a shift table over blocks of two words says how far the window may
jump, and where the shift is zero the block, being a pattern's suffix, selects a bucket whose patterns are
compared directly. Every hit is then extended in both directions, word by word and tolerating spelling
slips, to a run of the item's wording.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one pattern; runs of MIN_RUN words hold one even with a slip among them.
SEED = 4
#: Words of a run, "about ten".
MIN_RUN = 9
#: Share of the item's words that has to stand in runs, within STRETCH times the item's length.
SHARE, STRETCH = 0.4, 2.0
#: A window of STOCK_WORDS words in at least STOCK_ITEMS items of different wording is a stock sentence's; items that are leaks of one another are one wording.
STOCK_WORDS, STOCK_ITEMS = 8, 3
#: Diagonals of an item: more than a text has words.
SPAN = 1 << 40
#: Bytes of item text searched for at once; larger item sets are searched in blocks.
BLOCK_BYTES = 16 << 20

#: Scripts that put no spaces between words (fixed values): Thai, Lao, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(1 << 16)
def near(a: str, b: str) -> bool:
    """Equal but for a spelling slip: one edit (a swap of neighbours is one), two in words of nine letters or more."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < 4 or abs(n - m) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    most = 2 if min(n, m) >= 9 else 1
    before, last = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            cost = a[i - 1] != b[j - 1]
            x = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + cost)
            if cost and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            row[j] = x
        if min(row) > most:
            return False
        before, last = last, row
    return last[m] <= most


def covered(places: list[int]) -> int:
    """Words that windows of STOCK_WORDS words at these places, in order, cover."""
    return sum(min(STOCK_WORDS, p - last) for last, p in zip([-STOCK_WORDS, *places], places))


def wordings(windows: dict[int, list[tuple[int, ...]]], size: dict[int, int]) -> dict[int, int]:
    """Item -> the first item that it is a leak of, or itself: as much of one of the two stands in common windows.

    Items meet the first ones of each wording through the windows that they share.
    """
    first, posts = {}, defaultdict(list)
    for i, gs in windows.items():
        common = defaultdict(list)
        for p, g in enumerate(gs):
            for j in posts.get(g, ()):
                common[j].append(p)
        first[i] = next((j for j, places in common.items() if covered(places) >= SHARE * min(size[i], size[j])), i)
        if first[i] == i:
            for g in set(gs):
                posts[g].append(i)
    return first


class WuManber:
    """All items' patterns, for one pass over each document."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.same: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, ws in {i: words(t) for i, t in items}.items():
            if ws:
                self.same[tuple(ws)].append(i)
        #: One item stands for all of the same wording.
        self.words = {same[0]: ws for ws, same in self.same.items()}
        self.ids: dict[str, int] = {}
        for ws in self.words.values():
            for w in ws:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.base = len(self.ids) + 1
        #: Whole items of fewer than SEED words, which the blocks can't hold.
        self.short: dict[tuple[int, ...], tuple[int, int, int]] = {}
        where: dict[tuple[int, ...], list[tuple[int, int, int]]] = defaultdict(list)
        held: dict[tuple[int, ...], set[int]] = defaultdict(set)
        grams = {}
        for k, (i, ws) in enumerate(self.words.items()):
            own = [self.ids[w] for w in ws]
            for p in range(len(own) - SEED + 1):
                where[tuple(own[p : p + SEED])].append((i, p, k * SPAN - p))
            if len(own) < SEED:
                self.short[tuple(own)] = (i, 0, k * SPAN)
            grams[i] = [tuple(own[p : p + STOCK_WORDS]) for p in range(len(own) - STOCK_WORDS + 1)]
        first = wordings(grams, {i: len(ws) for i, ws in self.words.items()})
        for i, gs in grams.items():
            for g in gs:
                held[g].add(first[i])
        self.lengths = sorted({len(k) for k in self.short})
        self.stock = {i: {q for p, g in enumerate(gs) if len(held[g]) >= STOCK_ITEMS for q in range(p, p + STOCK_WORDS)} for i, gs in grams.items()}
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], list[tuple[int, int, int]]]] = defaultdict(dict)
        for pattern, places in where.items():
            for k in range(1, SEED):
                block = pattern[k - 1] * self.base + pattern[k]
                self.shift[block] = min(self.shift.get(block, SEED - 1), SEED - 1 - k)
            self.bucket[pattern[-2] * self.base + pattern[-1]][pattern[:-2]] = places

    def hits(self, ids: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(place in the document, (item, place in it, its diagonal at place 0) of all items) of every pattern that occurs."""
        at, n, base, bucket, last = SEED - 1, len(ids), self.base, self.bucket, SEED - 1
        shift = self.shift.get
        while at < n:
            block = ids[at - 1] * base + ids[at]
            jump = shift(block, last)
            if jump:
                at += jump
                continue
            places = bucket[block].get(tuple(ids[at - last : at - 1]))
            if places:
                yield at - last, places
            at += 1
        for m in self.lengths:
            for at in range(n - m + 1):
                place = self.short.get(tuple(ids[at : at + m]))
                if place is not None:
                    yield at, [place]

    def runs(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (place in the document, place in the item, words) of its runs."""
        own = words(text)
        known = self.ids.get
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        done: dict[int, int] = {}  # item and diagonal -> where its last run ends
        end, items = len(own), self.words
        for at, places in self.hits([known(w, 0) for w in own]):
            for item, p, first in places:
                diagonal = first + at
                if done.get(diagonal, -1) > at:
                    continue
                ws = items[item]
                size = len(ws)
                a, q = at, p
                while a and q and (own[a - 1] == ws[q - 1] or near(own[a - 1], ws[q - 1])):
                    a -= 1
                    q -= 1
                b, r = at + SEED, p + SEED
                if size < SEED:
                    b, r = at + size, size
                while b < end and r < size and (own[b] == ws[r] or near(own[b], ws[r])):
                    b += 1
                    r += 1
                done[diagonal] = b
                if b - a >= MIN_RUN or b - a == size:
                    out[item].append((a, q, b - a))
        return out

    def leaked(self, text: str) -> dict[int, float]:
        """item -> the largest share of its words that stands in runs within one stretch, if that is enough.

        A run of nothing but stock does not count; of any other run every word does.
        """
        out = {}
        for item, runs in self.runs(text).items():
            n, stock = len(self.words[item]), self.stock[item]
            if sum(r[2] for r in runs) < SHARE * n:
                continue
            place = sorted((a + k, q + k) for a, q, m in runs if not stock.issuperset(range(q, q + m)) for k in range(m))
            count: Counter = Counter()
            start = best = 0
            for at, q in place:
                count[q] += 1
                while at - place[start][0] >= STRETCH * n:
                    old = place[start][1]
                    count[old] -= 1
                    if not count[old]:
                        del count[old]
                    start += 1
                best = max(best, len(count))
            if best >= SHARE * n:
                out.update(dict.fromkeys(self.same[tuple(self.words[item])], best / n))
        return out


_searches: dict[str, WuManber] = {}


def search_of(name: str, block: list[tuple[int, str]]) -> WuManber:
    """The tables of a block, made once in a worker process, which Spark reuses for later tasks."""
    if name not in _searches:
        _searches.clear()
        _searches[name] = WuManber(block)
    return _searches[name]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size. Only this side, the stated query set, comes to the driver."""
    block, size = [], 0
    for i, t in items.where(F.col(text_col).isNotNull()).select(id_col, text_col).distinct().toLocalIterator():
        block.append((i, t))
        size += len(t)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(id, item, share) of each document that holds a passage of an item, whole or in part.

    Documents are searched where they are read, once for each block of items; nothing is shuffled but the
    hits. Null and empty texts on either side have no words and no hits, items of fewer than MIN_RUN words
    are found where the whole item stands, and repeated rows give one result row.
    """
    kinds = dict(docs.select(id_col).dtypes) | dict(items.select(item_col).dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds[item_col]}, share double"
    sc = docs.sparkSession.sparkContext
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_col, item_text):
        sent, name = sc.broadcast(block), uuid.uuid4().hex

        def run(parts: Iterator[pd.DataFrame], sent=sent, name=name) -> Iterator[pd.DataFrame]:
            search = search_of(name, sent.value)
            for part in parts:
                got = [(i, item, share) for i, t in zip(part[id_col], part[text_col]) for item, share in search.leaked(t).items()]
                yield pd.DataFrame(got, columns=[id_col, item_col, "share"])

        out = out.union(docs.select(id_col, text_col).where(F.length(text_col) > 0).mapInPandas(run, schema))
    return out.dropDuplicates([id_col, item_col])
