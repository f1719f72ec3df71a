"""Matching by nearest time as a stateful streaming join.

Both sides are one stream of events with a watermark. The operator buffers both sides; a left row is emitted
once the watermark has passed its tolerance horizon (its time plus the tolerance), when no nearer right row can
come any more, and right rows that no waiting or later left row can reach are evicted.

A cell is an entity's stretch of seconds, so that a long entity is many tasks' work; right rows within the
tolerance of a neighbouring stretch go to it too, and a stretch with more than HOT left rows is split by a hash
of their ids. The state's keys are buckets of cells of about BUCKET_ROWS rows. Stored tables come in no order of
time: they are written anew in slabs of time, of which one after the other is handed to the stream, and a last
row far in the future moves the watermark past every horizon.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkgraph.functions.shared import new_path

#: Seconds of one key's stretch of time; at least the tolerance is taken.
SEGMENT = 1800.0
#: Left rows that a cell holds, and rows that a bucket of cells holds about.
HOT, BUCKET_ROWS = 200_000, 20_000
#: Rows of one slab of a stored table, and the least number of slabs.
SLAB_ROWS, SLABS = 20_000_000, 2
#: Event times begin here, so that none lies before the first watermark, and take at most so many seconds.
BASE, RANGE = 1_000_000_000, 4_000_000_000
_END = BASE + RANGE + 1_000_000_000
#: Event times are kept in microseconds; a horizon counts as passed this much later.
_GUARD = 5e-6

_OUT = "left_id string, right_id string, gap double"
_STATE = "cells array<string>, lefts array<boolean>, ids array<string>, times array<double>"
_EVENT = "bucket int, cell string, side string, id string, t double, event_time timestamp"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Clock(NamedTuple):
    """Event time of a time: seconds after ``lo``, shrunk by ``scale`` where the data's range asks for it. Order is kept."""

    lo: float = 0.0
    scale: float = 1.0

    def of(self, t):
        return (t - self.lo) * self.scale + BASE


def taking_part(df: DataFrame, entity: str, id_col: str, time_col: str) -> DataFrame:
    """(entity, id, t) of the rows with an entity, an id and a finite time."""
    t = F.col(time_col).cast("double")
    return df.where(F.col(entity).isNotNull() & F.col(id_col).isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))).select(F.col(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), t.alias("t"))


def events(rows: DataFrame, side: str, tolerance: float, buckets: int, clock: Clock = Clock(), segment: float = SEGMENT, hot: DataFrame | None = None) -> DataFrame:
    """One row per record (entity, id, t) and cell that needs it. hot: (entity, stretch, parts) of the stretches that are split."""
    t, left = F.col("t"), side == "left"
    at = lambda x: F.floor(x / segment)
    slack = tolerance * (1 + 1e-9) + 1e-6
    out = rows.withColumn("stretch", at(t) if left else F.explode(F.sequence(at(t - slack), at(t + slack))))
    out = out.withColumn("parts", F.lit(1)) if hot is None else out.join(hot, ["entity", "stretch"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int") if left else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cell = F.concat_ws("\u001f", F.col("entity"), F.col("stretch").cast("string"), F.col("part").cast("string"))
    return out.withColumn("part", part).select(F.pmod(F.xxhash64("entity", "stretch", "part"), F.lit(buckets)).cast("int").alias("bucket"), cell.alias("cell"), F.lit(side).alias("side"), "id", "t", F.timestamp_seconds(clock.of(t)).alias("event_time"))


def pair(cell: np.ndarray, left: np.ndarray, ids: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, their nearest right rows, gaps) of the rows (cell number, side, id, time); left rows of a cell
    without a right row are left out. Ties go to the earlier time, then to the smaller id."""
    rank = np.zeros(len(t), int)
    rank[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(t))
    # right rows of one time in order of id backwards, so that the last one before and the first one after differ only in time
    order = np.lexsort((np.where(left, 0, -rank), left, t, cell))
    cell, left, t = cell[order], left[order], t[order]
    place = np.arange(len(t))
    before = np.maximum.accumulate(np.where(left, -1, place))
    # the smallest id of a time is its last row: of the rows after, the end of the first time's stretch
    ends = np.append((cell[1:] != cell[:-1]) | (t[1:] != t[:-1]) | (left[1:] & ~left[:-1]), True)
    after = np.minimum.accumulate(np.where(~left & ends, place, len(t))[::-1])[::-1]
    at = place[left]
    b, a = before[left], after[left]
    ok_b, ok_a = (b >= 0) & (cell[b] == cell[at]), (a < len(t)) & (cell[np.minimum(a, len(t) - 1)] == cell[at])
    a = np.minimum(a, len(t) - 1)
    gap_b, gap_a = np.where(ok_b, t[at] - t[b], np.inf), np.where(ok_a, t[a] - t[at], np.inf)
    got = ok_b | ok_a
    return order[at][got], order[np.where(gap_b <= gap_a, b, a)][got], np.minimum(gap_b, gap_a)[got]


def matcher(tolerance: float, clock: Clock = Clock()):
    """The stateful operator of one bucket of cells."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = (object, bool, object, float)
        rows = [tuple(np.array(x, kind) for x, kind in zip(state.get, kinds))] if state.exists else []
        rows += [(b["cell"].to_numpy(object), (b["side"] == "left").to_numpy(bool), b["id"].to_numpy(object), b["t"].to_numpy(float)) for b in batches]
        cells, left, ids, t = (np.concatenate([r[k] for r in rows]) for k in range(4))
        mark = state.getCurrentWatermarkMs() / 1000
        ripe = left & (clock.of(t + tolerance) + _GUARD < mark)
        if ripe.any():
            use = ripe | ~left
            at, near, gap = pair(pd.factorize(cells[use])[0], left[use], ids[use], t[use])
            own, got = ids[use], gap <= tolerance
            if got.any():
                yield pd.DataFrame({"left_id": own[at[got]], "right_id": own[near[got]], "gap": gap[got]})
        # a right row serves left rows up to one tolerance later, which wait for one tolerance more
        keep = np.where(left, ~ripe, clock.of(t + 2 * tolerance) + _GUARD >= mark)
        if keep.any():
            cells, left, ids, t = cells[keep], left[keep], ids[keep], t[keep]
            state.update((cells.tolist(), left.tolist(), ids.tolist(), t.tolist()))
            due = clock.of(t[left].min() + tolerance if left.any() else t.max() + 2 * tolerance)
            state.setTimeoutTimestamp(int(max(due * 1000, state.getCurrentWatermarkMs())) + 1)
        elif state.exists:
            state.remove()

    return step


def nearest_stream(both: DataFrame, tolerance: float, clock: Clock = Clock(), delay: str = "0 seconds") -> DataFrame:
    """The join of a stream of events() of both sides; delay is how late a row may come."""
    keys = both.withWatermark("event_time", delay).groupBy("bucket")
    return keys.applyInPandasWithState(matcher(tolerance, clock), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _slabs(left: DataFrame, right: DataFrame, tolerance: float) -> tuple[DataFrame, Clock, int]:
    """The events of stored tables with their slab of time, the clock and the number of slabs."""
    both = left.select("t").union(right.select("t"))
    shares = F.percentile_approx("t", [i / 64 for i in range(1, 64)], 1000)
    lo, hi, n, shares = both.agg(F.min("t"), F.max("t"), F.count("*"), shares).first()
    if not n:
        lo, hi, shares = 0.0, 0.0, []
    n_slabs = min(64, max(SLABS, -(-n // SLAB_ROWS)))
    cuts = sorted({shares[63 * i // n_slabs] for i in range(1, n_slabs)} if shares else ())
    clock, segment = Clock(lo, min(1.0, RANGE / (hi - lo)) if hi > lo else 1.0), max(SEGMENT, tolerance)
    buckets = max(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS)
    stretches = left.groupBy("entity", F.floor(F.col("t") / segment).alias("stretch")).agg(F.count("*").alias("n"))
    hot = stretches.where(F.col("n") > HOT).select("entity", "stretch", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = None if hot.isEmpty() else hot
    # right rows of one time are one row, the one that would win
    right = right.groupBy("entity", "t").agg(F.min("id").alias("id"))
    made = events(left, "left", tolerance, buckets, clock, segment, hot).unionByName(events(right, "right", tolerance, buckets, clock, segment, hot))
    slab = sum(((F.col("t") > c).cast("int") for c in cuts), F.lit(0))
    return made.withColumn("slab", slab), clock, len(cuts) + 1


def nearest(spark: SparkSession, left: tuple[str, str, str], right: tuple[str, str, str], entity: str, tolerance: float) -> DataFrame:
    """(left_id, right_id, gap) of stored tables; left and right are (path, id column, time column).

    For each left row with a time, the right row of the same entity with the least absolute difference,
    before or after, if that is at most the tolerance; ties go to the earlier right row, then to the smaller
    id. Rows without entity, id or finite time don't take part, repeated rows give one result row, and an empty
    table on either side gives an empty result. Times may be on any scale, and the tolerance as long as any.
    """
    sides = [taking_part(spark.read.parquet(path), entity, id_col, time_col) for path, id_col, time_col in (left, right)]
    rows, clock, n_slabs = _slabs(*sides, tolerance)
    store, feed, out, state = (new_path(spark, f"nearest-{x}") for x in ("slabs", "feed", "out", "state"))
    rows.write.partitionBy("slab").parquet(store)
    end = spark.createDataFrame([(0, "", "right", "end", clock.lo)], "bucket int, cell string, side string, id string, t double")
    end.withColumn("event_time", F.timestamp_seconds(F.lit(_END))).coalesce(1).write.mode("append").parquet(f"{store}/slab={n_slabs - 1}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(feed))
    was = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        both = spark.readStream.schema(_EVENT).parquet(f"{feed}/*")
        q = nearest_stream(both, tolerance, clock).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").start()
        try:
            for i in range(n_slabs):
                if fs.exists(path(f"{store}/slab={i}")):
                    if not fs.rename(path(f"{store}/slab={i}"), path(f"{feed}/{i}")):
                        raise OSError(f"slab {i} could not be handed to the stream")
                    q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.unset(_ROCKS[0]) if was is None else spark.conf.set(_ROCKS[0], was)
    return spark.read.schema(_OUT).parquet(out).distinct()
