"""Sequence rules of recordings: chunk ranges, overlapping segments, onset of speech. All but cut_ranges are folds in the JVM."""

from __future__ import annotations

import math
from collections import deque
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = "array<struct<s:double,e:double>>"


def chunk_ranges(duration: Column, pauses: Column, target: float = 30.0, least: float = 20.0, most: float = 35.0, lap: float = 1.5) -> Column:
    """Ranges of a recording to transcribe, cut at the pause nearest the target, each beginning a little before the last one's end.

    pauses: array of (s, e); those of 0.2 s and more count, by their start. No duration gives one empty range.
    The whole recording is one row and its pauses are gone through for each range: for short ones; cut_ranges does any length.
    """
    points = F.array_sort(F.transform(F.filter(pauses, lambda p: (p["e"] - p["s"] >= 0.2) & (p["s"] > 0) & (p["s"] < duration)), lambda p: p["s"]))
    zero = F.struct(F.lit(0.0).alias("cur"), F.lit(False).alias("done"), F.array().cast(_RANGE).alias("out"))
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.coalesce(duration, F.lit(0.0)) / (least - lap)).cast("int")) + 1)

    def step(a: Column, _: Column) -> Column:
        cur = a["cur"]
        goal, lo, hi = (F.least(duration, cur + x) for x in (target, least, most))
        stop = a["done"] | (hi <= cur + 0.05)
        near = F.array_min(F.transform(F.filter(points, lambda p: (p >= lo) & (p <= hi)), lambda p: F.struct(F.abs(p - goal).alias("d"), p.alias("p"))))
        cut0 = F.coalesce(near["p"], hi)
        cut = F.when(cut0 <= cur + 0.05, goal).otherwise(cut0)
        back = F.greatest(F.lit(0.0), cut - lap)
        return F.struct(
            F.when(stop, cur).otherwise(F.when(back <= cur + 0.01, cut).otherwise(back)).alias("cur"),
            (stop | (cut >= duration)).alias("done"),
            F.when(stop, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(F.round(cur, 3).alias("s"), F.round(cut, 3).alias("e"))))).alias("out"),
        )

    whole = F.array(F.struct(F.lit(0.0).alias("s"), F.round(F.greatest(F.lit(0.0), F.coalesce(duration, F.lit(0.0))), 3).alias("e")))
    made = F.aggregate(rounds, zero, step, lambda a: a["out"])
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, whole).when(F.size(made) == 0, whole).otherwise(made)


def cut_ranges(durations: DataFrame, pauses: DataFrame, target: float = 30.0, least: float = 20.0, most: float = 35.0, lap: float = 1.5, rows: int = 50_000) -> DataFrame:
    """(sample_id, i, s, e): ranges of each recording (sample_id, duration) to transcribe, cut at the pause (sample_id, s, e) nearest
    the target, each beginning a little before the last one's end.

    Pauses of 0.2 s and more count, by their start. No duration gives one empty range. Pauses come in order of time and a
    recording is gone through once; only those within reach of the next cut are held.
    """
    d = durations.select("sample_id", F.greatest(F.lit(0.0), F.coalesce(F.col("duration").cast("double"), F.lit(0.0))).alias("d"))
    at = d.join(pauses.where("e - s >= 0.2 and s > 0").select("sample_id", F.col("s").cast("double").alias("p")), "sample_id").where("p < d")
    kind = dict(d.dtypes)["sample_id"]
    events = d.select("sample_id", "d", F.lit(None).cast("double").alias("p")).union(at.select("sample_id", "d", "p"))
    ordered = events.repartition("sample_id").sortWithinPartitions("sample_id", F.asc_nulls_first("p"))

    def run(parts):
        out, held = [], deque()
        key, end, cur, i, open_ = None, 0.0, 0.0, 0, False

        def cuts(seen: float):
            """The ranges that no pause from ``seen`` on can change."""
            nonlocal cur, i, open_
            while open_:
                goal, lo, hi = (min(end, cur + x) for x in (target, least, most))
                if hi <= cur + 0.05:
                    open_ = False
                    break
                if seen <= hi:
                    return
                while held and held[0] < lo:
                    held.popleft()
                near = min(((abs(p - goal), p) for p in takewhile(lambda p: p <= hi, held)), default=(0.0, hi))[1]
                cut = goal if near <= cur + 0.05 else near
                yield key, i, cur, cut
                i, open_ = i + 1, cut < end
                back = max(0.0, cut - lap)
                cur = cut if back <= cur + 0.01 else back
            if not i and seen == math.inf:
                yield key, 0, 0.0, end
                i = 1

        frame = lambda: pd.DataFrame(out, columns=["sample_id", "i", "s", "e"])
        started = False
        for part in parts:
            for k, d_, p in zip(part["sample_id"], part["d"].tolist(), part["p"].tolist()):
                new = p != p  # a recording's own row comes first
                for r in cuts(math.inf if new else p) if started else ():
                    out.append(r)
                    if len(out) >= rows:
                        yield frame()
                        out.clear()
                if new:
                    key, end, cur, i, open_, started = k, d_, 0.0, 0, True, True
                    held.clear()
                elif open_:
                    held.append(p)
        for r in cuts(math.inf) if started else ():
            out.append(r)
            if len(out) >= rows:
                yield frame()
                out.clear()
        yield frame()

    made = ordered.mapInPandas(run, f"sample_id {kind}, i int, s double, e double")
    return made.select("sample_id", "i", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


def fixed_ranges(start: Column, end: Column, most: float) -> Column:
    """A range in pieces of at most ``most`` seconds; nothing of an empty range."""
    n = F.greatest(F.lit(1), F.ceil((end - start) / most)).cast("int")
    piece = lambda i: F.struct(F.round(start + i * most, 3).alias("s"), F.round(F.least(end, start + (i + 1) * most), 3).alias("e"))
    return F.when(end <= start, F.array().cast(_RANGE)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), piece))


def without_overlaps(segments: DataFrame) -> DataFrame:
    """Segments (sample_id, s, e, text) in order, without those that repeat the last one kept: they overlap it and one
    text holds the other; the longer text stays.

    Only segments that overlap can repeat one another, so each stretch of overlapping segments is folded by itself.
    """
    before = Window.partitionBy("sample_id").orderBy("s", "e", "text")
    marked = segments.withColumn("reach", F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = (F.col("reach").isNull() | (F.col("reach") <= F.col("s"))).cast("int")
    islands = marked.withColumn("grp", F.sum(fresh).over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy("sample_id", "grp").agg(F.array_sort(F.collect_list(F.struct("s", "e", "text"))).alias("xs"))
    norm = lambda t: F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"\s+", " "))
    zero = F.array().cast("array<struct<s:double,e:double,text:string>>")

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        new, old = norm(x["text"]), norm(last["text"])
        repeat = (F.least(x["e"], last["e"]) - F.greatest(x["s"], last["s"]) > 0) & ((new == old) | ((new != "") & F.contains(old, new)) | ((old != "") & F.contains(new, old)))
        rest = F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1))
        return F.when(last.isNull() | ~repeat, F.concat(kept, F.array(x))).when(F.length(new) > F.length(old), F.concat(rest, F.array(x))).otherwise(kept)

    return islands.select("sample_id", F.explode(F.aggregate("xs", zero, step)).alias("x")).select("sample_id", "x.*")


def speech_onset(words: Column, segments: Column, run: int = 4, longest: float = 1.2, gap: float = 1.5, least: float = 0.2) -> Column:
    """Start of speech: of the first run of words (s, e, text), none too long and none too far from the last; else of
    the first word that isn't too long; else of the first segment (s, e) of some length; null if there is none.

    Words without letters or without a length don't count.
    """
    w = F.array_sort(F.filter(words, lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & (x["e"] > x["s"])))
    short = lambda x: x["e"] - x["s"] <= longest
    near = lambda j, i: (j == i) | (F.element_at(w, j)["s"] - F.element_at(w, F.greatest(F.lit(1), j - 1))["s"] <= gap)
    good = lambda i: F.forall(F.sequence(i, i + run - 1), lambda j: short(F.element_at(w, j)) & near(j, i))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - run + 1)), good)
    first = F.when((F.size(w) >= run) & (F.size(starts) > 0), F.element_at(w, F.array_min(starts))["s"])
    lone = F.try_element_at(F.filter(w, short), F.lit(1))["s"]
    return F.coalesce(first, lone, F.array_min(F.transform(F.filter(segments, lambda x: x["e"] - x["s"] >= least), lambda x: x["s"])))


def pitch_slope(samples: Column) -> Column:
    """Mean of the last third less mean of the first third of the finite samples; 0 for fewer than six."""
    f = F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    k = F.greatest(F.lit(1), F.floor(F.size(f) / 3).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / k
    return F.when(F.size(f) < 6, 0.0).otherwise(mean(F.slice(f, F.size(f) - k + 1, k)) - mean(F.slice(f, F.lit(1), k)))


def shifted(utterances: DataFrame, by: float) -> DataFrame:
    """Utterances whose start, end and words lie ``by`` seconds later; times that are null stay so."""
    move = lambda w: w.withField("start", w["start"] + by).withField("end", w["end"] + by)
    return utterances.withColumns({"start_time": F.col("start_time") + by, "end_time": F.col("end_time") + by, "word_timestamps": F.transform("word_timestamps", move)})


def silences(log: DataFrame) -> DataFrame:
    """(key, s, e) of the silences that an audio filter's log lines (key, n, line) tell of: a start, then its end and length;
    an end without a start counts from its length, a start without an end is dropped."""
    start = F.regexp_extract("line", r"silence_start:\s*(-?[0-9.]+)", 1).try_cast("double")
    end = F.regexp_extract("line", r"silence_end:\s*(-?[0-9.]+)", 1).try_cast("double")
    length = F.regexp_extract("line", r"silence_duration:\s*([0-9.]+)", 1).try_cast("double")
    x = log.select("key", "n", start.alias("a"), end.alias("b"), length.alias("l")).where("a is not null or b is not null")
    last = F.lag("a").over(Window.partitionBy("key").orderBy("n"))
    return x.withColumn("s", F.coalesce(last, F.col("b") - F.col("l"))).where("b is not null and s is not null").select("key", F.greatest(F.lit(0.0), F.col("s")).alias("s"), F.col("b").alias("e"))


def loudness(log: DataFrame) -> DataFrame:
    """(key, t, v) of loudness log lines (key, n, line): each level belongs to the last time told before it; infinite levels count as -120."""
    t = F.regexp_extract("line", r"pts_time:\s*(-?[0-9.]+)", 1).try_cast("double")
    v = F.regexp_extract("line", r"RMS_level=\s*(-?(?:[0-9.]+|inf))", 1)
    x = log.select("key", "n", t.alias("t0"), F.when(v.contains("inf"), -120.0).otherwise(v.try_cast("double")).alias("v"))
    w = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("t", F.last("t0", ignorenulls=True).over(w)).where("v is not null and t is not null").select("key", "t", "v")


def duration(log: DataFrame) -> DataFrame:
    """(key, seconds) of the line with a recording's length, hh:mm:ss or seconds."""
    p = lambda i: F.regexp_extract("line", r"Duration:\s*(\d+):(\d+):([0-9.]+)", i).try_cast("double")
    plain = F.regexp_extract("line", r"^\s*(?:duration=)?([0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast("double")
    return log.select("key", F.coalesce(p(1) * 3600 + p(2) * 60 + p(3), plain).alias("seconds")).where("seconds is not null").groupBy("key").agg(F.max("seconds").alias("seconds"))


def clips(files: DataFrame, ranges: DataFrame, cutter) -> DataFrame:
    """(key, s, e, clip) of recordings (key, path) and ranges (key, s, e): cutter (path, s, e) -> bytes is a provider; what it fails at is null."""

    def run(parts):
        for part in parts:
            out = []
            for path, a, b in zip(part["path"], part["s"], part["e"]):
                try:
                    out.append(cutter(path, a, b))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield part[["key", "s", "e"]].assign(clip=out)

    kind = dict(files.select("key").dtypes)["key"]
    return files.join(ranges, "key").select("key", "path", "s", "e").mapInPandas(run, f"key {kind}, s double, e double, clip binary")


def transcribed(clip_rows: DataFrame, model) -> DataFrame:
    """(key, s, e, text) of clips (key, s, e, clip): the model's segments (s, e, text) of a clip, moved to the recording's
    time, repeats of overlapping clips dropped. model: bytes -> list of (s, e, text); a clip it fails at has none."""

    def run(parts):
        for part in parts:
            rows = []
            for key, a, clip in zip(part["key"], part["s"], part["clip"]):
                try:
                    rows += [(key, a + s, a + e, t) for s, e, t in (model(bytes(clip)) if clip is not None else [])]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["sample_id", "s", "e", "text"])

    kind = dict(clip_rows.select("key").dtypes)["key"]
    made = clip_rows.select("key", "s", "clip").mapInPandas(run, f"sample_id {kind}, s double, e double, text string")
    return without_overlaps(made).withColumnRenamed("sample_id", "key")
