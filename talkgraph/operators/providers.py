"""External models behind pluggable functions, with deterministic offline defaults.

A provider is a function of a list of inputs that returns a list of outputs; it is called once for each Arrow
batch of distinct inputs.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

Provider = Callable[[list[str]], list]
#: Characters of a text that are embedded (the services' limit, fixed value).
EMBED_CHARS = 4000


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline default: words hashed to signed dimensions, unit length; zeros for a text without words."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


#: What the prompts say around their context: up to it, and between it and the question.
_LEAD = re.compile(r"[^\n]*\n(?:[^\n]*\nEvidence:\n|The graph has \d+ nodes [^\n]*\n)?")
_TAIL = "\nFollow the relations to what the question asks for."


def keyword_answer(prompts: list[str]) -> list[str]:
    """Offline default of a chat model: the context's line that holds most of the question's words, rare ones counting more
    (the first of several); no answer where no line holds any."""
    words = lambda x: set(re.findall(r"\w+", x.lower()))
    out = []
    for p in prompts:
        head, _, question = p.removesuffix("\nAnswer:").rpartition("\nQuestion: ")
        lead = _LEAD.match(f"{head}\n")
        lines = [x.strip() for x in head[lead.end() :].removesuffix(_TAIL).split("\n") if x.strip()] if lead else []
        asked = sorted(words(question))
        held = [{w for w in asked if w in own} for own in map(words, lines)]
        rare = {w: math.log(1 + len(lines) / n) if (n := sum(w in h for h in held)) else 0.0 for w in asked}
        best = max(range(len(lines)), key=lambda i: sum(rare[w] for w in asked if w in held[i]), default=None)
        out.append(lines[best] if best is not None and held[best] else "No answer.")
    return out


def called(df: DataFrame, text_col: str, out_col: str, out_type: str, provider: Provider, lanes: int | None = None, interval_s: float = 0.0, retries: int = 3, dead: str | None = None) -> DataFrame:
    """df with the provider's output for each text; null texts get null.

    Distinct texts are the cache. lanes bounds the tasks that call a remote service at once; without it every task calls.
    A batch that fails is retried, then its items one by one; what fails for good gets null, and with ``dead`` its
    text and error are written to that folder, the dead letters.
    """
    df = df.withColumn("_k", F.unhex(F.md5(text_col)))  # texts are met again by their hash, which takes less room
    todo = df.select("_k", F.col(text_col).alias("_t")).where("_t is not null").dropDuplicates(["_k"])
    todo = todo.repartition(lanes, "_k") if lanes else todo

    def tried(texts: list[str]) -> tuple[list | None, str]:
        error = ""
        for attempt in range(retries):
            try:
                return provider(texts), ""
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[:500]
                time.sleep(min(8.0, 0.8 * 2**attempt) if interval_s else 0)
        return None, error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["_t"].tolist()
            got, error = tried(texts)
            errors = [error] * len(texts)
            if got is None:
                each = [tried([t]) for t in texts]
                got, errors = [g[0] if g else None for g, _ in each], [e for _, e in each]
            if interval_s:
                time.sleep(interval_s * (lanes or 1))
            yield pd.DataFrame({"_k": part["_k"], "_t": texts if dead else None, out_col: got, "_error": [e or None for e in errors]})

    made = todo.mapInPandas(run, f"_k binary, _t string, `{out_col}` {out_type}, _error string")
    if dead:
        made = written(made, "provided")
        made.where("_error is not null").select(F.col("_t").alias("text"), F.col("_error").alias("error")).write.mode("append").json(dead)
    return df.join(made.drop("_t", "_error"), "_k", "left").drop("_k")


def embedded(df: DataFrame, text_col: str, provider: Provider = hashed_embedding) -> DataFrame:
    """df with an embedding of each text, cut to the services' limit."""
    cut = df.withColumn("_e", F.substring(text_col, 1, EMBED_CHARS))
    return called(cut, "_e", "embedding", "array<double>", provider).drop("_e")


def judged(df: DataFrame) -> DataFrame:
    """Offline judge: an answer is right if it says what the reference says, but for case and marks; a refusal is told by its words."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    refused = F.lower(F.coalesce("generated_answer", F.lit(""))).rlike(r"\b(cannot|can't|unable|not enough|insufficient|no answer|don't know|not possible)\b")
    return df.withColumn("is_correct", F.contains(norm("generated_answer"), norm("ground_truth_answer")) & (norm("ground_truth_answer") != "")).withColumn("properly_refused", refused)
