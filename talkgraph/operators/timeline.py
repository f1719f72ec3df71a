"""Interval, nearest and range joins over seconds, and sequence windows.

Joins on time are equi-joins on (session, stretch of BIN seconds), so that a long session is many keys; only
what has no bound in time (open ends, nearest rows beyond any overlap) is looked up per session, from one
row or in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one stretch.
BIN = 60.0


def bins(start: Column, end: Column) -> Column:
    """The stretches that a closed interval touches."""
    return F.sequence(F.floor(start / BIN), F.floor(F.greatest(start, end) / BIN))


def slide_at(points: DataFrame, slides: DataFrame, point_id: str, time: str) -> DataFrame:
    """(point_id, slide_id): for each point the first slide of its session, in order of start time and id, with
    start <= t < end; an open end reaches on, and so does the session's last slide. No slide gives null.
    Slides without a start are skipped. Equal rows count once.

    Closed slides are met by stretch; of the open ones only a session's first can win, and the last is one row.
    """
    own = slides.where("start_time is not null").select("sample_id", "slide_id", F.col("start_time").alias("s"), F.col("end_time").alias("e")).distinct()
    pos = F.struct("s", "slide_id", F.coalesce("e", F.lit(float("inf"))).alias("e"))
    ends = own.groupBy("sample_id").agg(F.min(F.when(F.col("e").isNull(), pos)).alias("open"), F.max(pos).alias("last"))
    closed = own.where("e is not null").select("sample_id", F.explode(bins(F.col("s"), F.col("e"))).alias("bin"), "s", "e", "slide_id")
    p = points.select("sample_id", F.col(point_id).alias("pid"), F.col(time).alias("t")).distinct()
    hits = (
        p.withColumn("bin", F.floor(F.col("t") / BIN)).join(closed, ["sample_id", "bin"]).where("s <= t and t < e")
        .groupBy("sample_id", "pid", "t").agg(F.min(F.struct("s", "slide_id")).alias("hit"))
    )
    two = lambda x: F.when(F.col(f"{x}.s") <= F.col("t"), F.struct(F.col(f"{x}.s").alias("s"), F.col(f"{x}.slide_id").alias("slide_id")))
    return (
        p.join(hits, ["sample_id", "pid", "t"], "left").join(ends, "sample_id", "left")
        .select(F.col("pid").alias(point_id), F.least("hit", two("open"), two("last")).getField("slide_id").alias("slide_id"))
    )


def linked_events(events: DataFrame, utterances: DataFrame) -> DataFrame:
    """Each event with the utterance of its session that it overlaps most (the earliest on a tie), or else the one
    whose middle is nearest; then clamped into it, 10 ms long at least.

    events: sample_id, event_id, s, e; utterances: sample_id, utterance_id, us, ue. Sessions without any
    utterance lose their events.
    """
    u = utterances.select("sample_id", "utterance_id", "us", "ue")
    met = (
        events.withColumn("bin", F.explode(bins(F.col("s"), F.col("e")))).join(u.withColumn("bin", F.explode(bins(F.col("us"), F.col("ue")))), ["sample_id", "bin"])
        .withColumn("overlap", F.least("e", "ue") - F.greatest("s", "us")).where("overlap > 0")
        .groupBy("sample_id", "event_id", "s", "e").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "us", "utterance_id", "ue")).alias("k"))
    )
    rest = events.join(met.select("sample_id", "event_id"), ["sample_id", "event_id"], "left_anti")
    mid = rest.select("sample_id", ((F.col("s") + F.col("e")) / 2).alias("m"), F.lit(None).cast("struct<us:double,utterance_id:string,ue:double>").alias("u"), F.struct("event_id", "s", "e").alias("ev")).union(
        u.select("sample_id", ((F.col("us") + F.col("ue")) / 2), F.struct("us", "utterance_id", "ue"), F.lit(None).cast("struct<event_id:string,s:double,e:double>"))
    )
    w = Window.partitionBy("sample_id").orderBy("m")
    at = F.when(F.col("u").isNotNull(), F.struct("m", "u"))
    near = (
        mid.withColumn("b", F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("a", F.first(at, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
        .where("ev is not null")
        .select("sample_id", "ev.*", F.least(*(F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.m") - F.col("m")).alias("o"), F.col(f"{x}.u.us").alias("us"), F.col(f"{x}.u.utterance_id").alias("utterance_id"), F.col(f"{x}.u.ue").alias("ue"))) for x in "ab")).alias("k"))
    )
    found = met.select("sample_id", "event_id", "s", "e", "k").unionByName(near.where("k is not null").select("sample_id", "event_id", "s", "e", "k"))
    s1 = F.greatest("s", "k.us")
    e1 = F.least(F.col("k.ue"), F.greatest(F.col("e"), s1 + 0.01))
    s2 = F.when(e1 <= s1, F.greatest(F.lit(0.0), e1 - 0.01)).otherwise(s1)
    return found.select("event_id", F.col("k.utterance_id").alias("utterance_id"), F.round(s2, 3).alias("start_time"), F.round(e1, 3).alias("end_time"))


def nearest_pause(utterances: DataFrame, pauses: DataFrame) -> DataFrame:
    """Each utterance (sample_id, utterance_id, us) with the pause (sample_id, ps, pe) whose end is nearest its start; ties to the earlier pause."""
    both = utterances.select("sample_id", F.col("us").alias("t"), F.lit(None).cast("struct<pe:double,ps:double>").alias("p"), "utterance_id").union(
        pauses.select("sample_id", F.col("pe").alias("t"), F.struct("pe", "ps"), F.lit(None).cast("string"))
    )
    w = Window.partitionBy("sample_id").orderBy("t")
    b = F.max(F.when(F.col("p").isNotNull(), F.struct("p.pe", (-F.col("p.ps")).alias("n")))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    a = F.min(F.when(F.col("p").isNotNull(), F.struct("p.pe", F.col("p.ps").alias("n")))).over(w.rangeBetween(0, Window.unboundedFollowing))
    c = lambda x, sign: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.pe") - F.col("t")).alias("gap"), (sign * F.col(f"{x}.n")).alias("ps"), F.col(f"{x}.pe").alias("pe")))
    return both.withColumn("b", b).withColumn("a", a).where("utterance_id is not null").withColumn("k", F.least(c("b", -1), c("a", 1))).where("k is not null").select("utterance_id", F.round("k.gap", 6).alias("gap"), F.col("k.ps").alias("pause_start"), F.col("k.pe").alias("pause_end"))


def range_average(spans: DataFrame, samples: DataFrame, default: float = -60.0) -> DataFrame:
    """Mean of the samples (sample_id, t, v) within each span (sample_id, span_id, s, e), both ends included; default if there is none."""
    hit = (
        spans.withColumn("bin", F.explode(bins(F.col("s"), F.col("e")))).join(samples.withColumn("bin", F.floor(F.col("t") / BIN)), ["sample_id", "bin"]).where("s <= t and t <= e")
        .groupBy("sample_id", "span_id").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    )
    return spans.join(hit, ["sample_id", "span_id"], "left").select("span_id", F.coalesce(F.col("mean"), F.lit(default)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def containing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (sample_id, pid, t) with the first span (sample_id, span_id, s, e) that has s <= t <= e, by start and id; points in no span are left out."""
    s = spans.withColumn("bin", F.explode(bins(F.col("s"), F.col("e"))))
    return (
        points.withColumn("bin", F.floor(F.col("t") / BIN)).join(s, ["sample_id", "bin"]).where("s <= t and t <= e")
        .groupBy("pid", "t").agg(F.min(F.struct("s", "span_id")).getField("span_id").alias("span_id"))
    )


def median_filter(df: DataFrame, group: str, order: list[str], value: str, half: int = 2) -> Column:
    """Median over a window of 2 * half + 1 rows cut off at the ends; groups of two rows or fewer stay as they are."""
    w = Window.partitionBy(group).orderBy(*order)
    med = F.expr(f"percentile({value}, 0.5)").over(w.rowsBetween(-half, half))
    return F.when(F.count("*").over(Window.partitionBy(group)) <= 2, F.col(value)).otherwise(med)


def z_score(group: str, value: str) -> Column:
    """Population z-score within a group; 0 for a group of one row or without spread."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop(value).over(w)
    return F.when((F.count(value).over(w) <= 1) | (sd <= 1e-8), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd)


def gap_sessions(words: DataFrame, gap: float = 0.8, punct_gap: float = 0.2) -> DataFrame:
    """Groups of words (sample_id, s, e, text): a new one after a gap, or after closing punctuation and a smaller gap."""
    w = Window.partitionBy("sample_id").orderBy("s", "e", "text")
    last_e, last_t = F.lag("e").over(w), F.lag("text").over(w)
    new = last_e.isNull() | (F.col("s") - last_e > gap) | (last_t.rlike(r"[.!?;:]$") & (F.col("s") - last_e > punct_gap))
    return words.withColumn("grp", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def utterances_of(words: DataFrame, gap: float = 0.8, punct_gap: float = 0.2, long_s: float = 16.0, long_n: int = 12) -> DataFrame:
    """(sample_id, start_time, end_time, n, text): utterances of recordings' words (sample_id, s, e, text), also cut
    when one has grown too long.

    Gaps and closing punctuation cut wherever they stand, so that only within such a stretch the length of the open
    utterance decides; that is a fold over the stretch's words, JVM-side.
    """
    g = "struct<s:double,e:double,n:int,text:string>"
    zero = F.struct(F.array().cast(f"array<{g}>").alias("done"), F.lit(None).cast(g).alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        c = acc["cur"]
        cut = (c["e"] - c["s"] > long_s) & (c["n"] >= long_n)
        fresh = F.struct(w["s"].alias("s"), w["e"].alias("e"), F.lit(1).alias("n"), w["text"].alias("text"))
        grown = F.struct(c["s"].alias("s"), w["e"].alias("e"), (c["n"] + 1).alias("n"), F.concat_ws(" ", c["text"], w["text"]).alias("text"))
        return F.struct(
            F.when(c.isNotNull() & cut, F.concat(acc["done"], F.array(c))).otherwise(acc["done"]).alias("done"),
            F.when(c.isNull() | cut, fresh).otherwise(grown).alias("cur"),
        )

    end = lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
    stretches = gap_sessions(words, gap, punct_gap).groupBy("sample_id", "grp").agg(F.array_sort(F.collect_list(F.struct("s", "e", "text"))).alias("ws"))
    return stretches.select("sample_id", F.explode(F.aggregate("ws", zero, step, end)).alias("u")).select("sample_id", F.col("u.s").alias("start_time"), F.col("u.e").alias("end_time"), "u.n", "u.text")


def pause_events(silences: DataFrame) -> DataFrame:
    """(sample_id, event_id, s, e, kind, intensity) of silences of at least 50 ms; long ones last 0.8 s and more."""
    d = F.col("e") - F.col("s")
    return silences.where(d >= 0.05).select("sample_id", "event_id", "s", "e", F.when(d >= 0.8, "PAUSE_LONG").otherwise("PAUSE").alias("kind"), F.round(F.least(F.lit(1.0), d / 2.0), 3).alias("intensity"))


def speech_segments(silences: DataFrame, durations: DataFrame, least: float = 0.15) -> DataFrame:
    """What the silences (sample_id, s, e) leave of each recording (sample_id, duration): a running maximum of the ends."""
    w = Window.partitionBy("sample_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    inner = silences.join(durations.where("duration > 0"), "sample_id").select("sample_id", F.coalesce(F.greatest(F.lit(0.0), F.max("e").over(w)), F.lit(0.0)).alias("a"), F.col("s").alias("b"))
    tail = durations.where("duration > 0").join(silences.groupBy("sample_id").agg(F.max("e").alias("m")), "sample_id", "left").select("sample_id", F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))).alias("a"), F.col("duration").alias("b"))
    return inner.union(tail).where(F.col("b") - F.col("a") >= least).select("sample_id", F.col("a").alias("start_time"), F.col("b").alias("end_time"))


def even_shards(items: Column, shards: int) -> Column:
    """Slices of an array at floor(n * i / shards): sizes differ by one at most, longer ones last."""
    n = F.size(items)
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.slice(items, (F.floor(n * i / shards) + 1).cast("int"), (F.floor(n * (i + 1) / shards) - F.floor(n * i / shards)).cast("int")))
