"""The best partners of each row within its group, by blocks of both sides.

Where a rule scores every pair of a group (a session), neither the group nor its pairs may meet in one task: both
sides are cut into blocks of about BLOCK rows by a hash of their ids, each pair of blocks is one small task that
scores its pairs as one matrix product, and only each row's best go on. A side is repeated once for each block
of the other side; no pair is shuffled, and the result is the same as that of scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block.
BLOCK = 1024


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as SQL rounds."""
    return np.floor(x * 10**places + 0.5) / 10**places


def common(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of common words, words of the left rows as a column, of the right rows as a row) of rows of distinct words, or of their hashes."""
    n, m = left.map(len).to_numpy(int), right.map(len).to_numpy(int)
    codes, _ = pd.factorize(np.concatenate([np.asarray(x) for x in (*left, *right) if len(x)] or [np.array([], int)]))
    width, split = (codes.max() + 1 if len(codes) else 1), n.sum()
    a, b = np.zeros((len(n), width), np.float32), np.zeros((len(m), width), np.float32)
    a[np.repeat(np.arange(len(n)), n), codes[:split]] = 1
    b[np.repeat(np.arange(len(m)), m), codes[split:]] = 1
    return (a @ b.T).astype(float), n[:, None].astype(float), m[None, :].astype(float)


def jaccard(left: pd.Series, right: pd.Series) -> np.ndarray:
    c, n, m = common(left, right)
    return c / np.maximum(1, n + m - c)


def overlap(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Common words over the words of the smaller side; 0 if either is empty."""
    c, n, m = common(left, right)
    return c / np.maximum(1, np.minimum(n, m))


def products(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Inner products of vectors."""
    return np.stack(left.to_list()).astype(float) @ np.stack(right.to_list()).astype(float).T


def best(left: DataFrame, right: DataFrame, group: list[str], score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], need: str = "need", tie: list[str] | None = None, descending: bool = False) -> DataFrame:
    """(lid, rid, score, rk): for each left row the ``need`` best right rows of its group; a NaN score makes no pair.

    left: group columns, lid, need and what score wants; right: group columns, rid and what score and tie want. lid and
    rid name a row within its group once. Ties go by the tie columns (rid if none are given). Rows with a null in the group
    meet no row, and empty sides give an empty result.
    """
    tie = tie or ["rid"]
    blocks = lambda df, name: df.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(left, "nl").join(blocks(right, "nr"), group)
    spread = lambda df, own, n, other, m: df.join(sizes, group).withColumn(own, F.pmod(F.xxhash64("lid" if own == "lb" else "rid"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("nl", "nr")
    key = [*group, "lb", "rb"]
    kinds = dict(left.dtypes)["lid"], dict(right.dtypes)["rid"]
    schema = f"lid {kinds[0]}, rid {kinds[1]}, score double, place int, need int"

    def step(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):  # a hash leaves some blocks without rows
            return pd.DataFrame({"lid": a["lid"][:0], "rid": b["rid"][:0], "score": np.zeros(0), "place": np.zeros(0, int), "need": np.zeros(0, int)})
        b = b.sort_values(tie, ascending=not descending, ignore_index=True)
        s = score(a, b)
        s = np.where(np.isnan(s), -np.inf, s)
        k = np.minimum(a[need].to_numpy(int), len(b))
        top = int(k.max()) if len(k) else 0
        at = np.argsort(-s, axis=1, kind="stable")[:, :top]
        got = np.take_along_axis(s, at, 1)
        row, col = np.nonzero((np.arange(top)[None, :] < k[:, None]) & (got > -np.inf))
        return pd.DataFrame({"lid": a["lid"].to_numpy()[row], "rid": b["rid"].to_numpy()[at[row, col]], "score": got[row, col], "place": col, "need": a[need].to_numpy()[row]})

    own, other = (df.toDF(*df.columns) for df in (spread(left, "lb", "nl", "rb", "nr"), spread(right, "rb", "nr", "lb", "nl")))  # columns of their own, where both come from one table
    met = own.groupBy(*key).cogroup(other.groupBy(*key)).applyInPandas(step, schema)
    extra = [c for c in tie if c != "rid"]
    if extra:
        met = met.join(right.select("rid", *extra).dropDuplicates(["rid"]), "rid")
    order = [F.desc(c) if descending else F.asc(c) for c in tie]
    w = Window.partitionBy("lid").orderBy(F.desc("score"), *order)
    return met.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= F.col("need")).select("lid", "rid", "score", "rk")
