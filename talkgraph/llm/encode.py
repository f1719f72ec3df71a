"""Token ids of whole texts by a byte-level BPE vocabulary, in two tiers.

Tier one: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary (checked against the
stored token). Tier two: the rest is merged by a heap over a linked list of bytes, O(n log n) for a
pre-token of n bytes, so that a very long one is no trouble.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame

#: Where the vocabulary file lies unless the caller says otherwise; it has to exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Keys per displacement bucket.
LOAD = 3
#: Pre-tokens a worker remembers before it starts anew; only speed depends on it.
MEMO = 400_000
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: one slot per key and no empty slot.

    A bucket of one key stores its slot (as -slot - 1); a larger one the displacement that spreads its keys
    over free slots. The token itself is kept in the slot, so strings outside the vocabulary are told apart.
    """

    def __init__(self, tokens: dict[bytes, int]) -> None:
        n = len(tokens)
        self.n, self.m = n, max(1, -(-n // LOAD))
        self.shift = np.zeros(self.m, np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.ids = np.full(n, -1, np.int64)
        buckets: dict[int, list[tuple[bytes, int]]] = {}
        for key in tokens:
            b, f = self._parts(key)
            buckets.setdefault(b, []).append((key, f))
        free = np.ones(n, bool)
        singles = []
        for b, entries in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(entries) == 1:
                singles.append((b, entries[0][0]))
                continue
            d = 0
            while True:
                slots = [self._slot(f, d) for _, f in entries]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for (key, _), s in zip(entries, slots):
                self._put(s, key, tokens[key], free)
        for (b, key), s in zip(singles, np.flatnonzero(free).tolist()):
            self.shift[b] = -s - 1
            self._put(s, key, tokens[key], free)

    def _put(self, slot: int, key: bytes, value: int, free: np.ndarray) -> None:
        self.keys[slot], self.ids[slot], free[slot] = key, value, False

    def _parts(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.m, h & _MASK

    def _slot(self, f: int, d: int) -> int:
        x = (f + d * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's id, -1 if it is not in the vocabulary."""
        if not self.n:
            return -1
        b, f = self._parts(key)
        d = int(self.shift[b])
        slot = -d - 1 if d < 0 else self._slot(f, d)
        return int(self.ids[slot]) if self.keys[slot] == key else -1


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair with the lowest rank is merged again and again, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := rank.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.table, self.find = ranks, PerfectHash(ranks), regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty text and null give an empty list. Names of special tokens are ordinary text."""
        if not text:
            return []
        memo, out = self.memo, []
        for p in self.find(text):
            ids = memo.get(p)
            if ids is None:
                raw = p.encode("utf-8", "surrogatepass")
                one = self.table.get(raw)
                ids = [one] if one >= 0 else merge(raw, self.ranks)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(p) <= 64:
                    memo[p] = ids
            out += ids
        return out


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process, which Spark reuses for later tasks."""
    with open(path, "rb") as f:
        return Encoder(read_ranks(f))


def token_ids(docs: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id, ids) of each row; whole texts, without special tokens. Empty and null texts give an empty list.

    Rows are encoded where they are read: nothing is shuffled.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for part in parts:
            yield pd.DataFrame({id_col: part[id_col], "ids": [enc.encode(t) for t in part[text_col]]})

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")
