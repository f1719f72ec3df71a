"""One ranking from scores on different scales: reciprocal rank fusion within each session.

Every score gives a standing within its scale, the items of a session are ranked by each standing
separately, and the inverses of rank plus a constant are added up. Ranks of a session are found without
bringing the session into one task: equal values are counted first, the counts of a bucket of values
give where the bucket begins, and only the distinct values of one bucket are put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

#: The constant of reciprocal rank fusion, as published.
RRF_K = 60
#: Buckets of values up to 1, and of each doubling beyond; a bucket's distinct values meet in one task.
BUCKETS, BUCKETS_BEYOND = 4096, 512
#: Tiers in order (fixed values); anything else stands below.
TIERS = ("strong", "medium")


def tier_level(tier: Column) -> Column:
    """2 for strong, 1 for medium, 0 for anything else or null, whatever the spelling."""
    t = F.lower(F.regexp_replace(tier, r"[^\p{L}]", ""))
    return F.when(t == TIERS[0], 2).when(t == TIERS[1], 1).otherwise(0)


def standing(values: DataFrame, scale: str, value: str) -> DataFrame:
    """(scale, value, pct): the share of a scale's rows that have a smaller value.

    Distinct values are counted, put in range partitions and added up within each; the partitions' totals,
    one row for each partition and scale, give the rest.
    """
    counted = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(scale, value).agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange(scale, value).withColumn("part", F.spark_partition_id()), "standing")
    sums = ranged.groupBy(scale, "part").agg(F.sum("n").alias("s"))
    by_scale = Window.partitionBy(scale)
    starts = sums.select(scale, "part", (F.sum("s").over(by_scale.orderBy("part")) - F.col("s")).alias("start"), F.sum("s").over(by_scale).alias("total"))
    inner = F.sum("n").over(Window.partitionBy("part", scale).orderBy(value)) - F.col("n")
    at = ranged.withColumn("inner", inner).alias("a")
    st = starts.alias("s")
    return at.join(st, F.col(f"a.{scale}").eqNullSafe(F.col(f"s.{scale}")) & (F.col("a.part") == F.col("s.part"))).select(
        f"a.{scale}", f"a.{value}", ((F.col("inner") + F.col("start")) / F.col("total")).alias("pct")
    )


def bucket(value: Column) -> Column:
    """A bucket's number, growing with the value on any scale."""
    size = F.abs(value)
    return F.floor(F.signum(value) * F.when(size <= 1, size * BUCKETS).otherwise(BUCKETS + F.log2(size) * BUCKETS_BEYOND))


def ranks(items: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """(group, value, out): of each distinct value of a group, 1 + the number of the group's items above it."""
    counted = items.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("b", bucket(F.col(value)))
    buckets = counted.groupBy(group, "b").agg(F.sum("n").alias("s"))
    above = buckets.select(group, "b", (F.sum("s").over(Window.partitionBy(group).orderBy(F.desc("b"))) - F.col("s")).alias("above"))
    inner = F.sum("n").over(Window.partitionBy(group, "b").orderBy(F.desc(value))) - F.col("n")
    c, a = counted.withColumn("inner", inner).alias("c"), above.alias("a")
    return c.join(a, F.col(f"c.{group}").eqNullSafe(F.col(f"a.{group}")) & (F.col("c.b") == F.col("a.b"))).select(f"c.{group}", f"c.{value}", (F.col("inner") + F.col("above") + 1).alias(out))


def ranked(kg: DataFrame) -> DataFrame:
    """sample_id, triple_id, the three ranks within the session, and rrf.

    weight stands by its share among the triples of its signal_source (null or NaN: lowest), similarity by
    the highest similarity_score in provenance (none: lowest), tier by its level. Equal values share the
    best rank of theirs. Repeated rows are one item, a null triple_id is an id like any other.
    """
    sims = F.filter("provenance.similarity_score", lambda x: x.isNotNull() & ~F.isnan(x))
    base = kg.select(
        "sample_id", "triple_id", "signal_source", "weight", F.coalesce(F.array_max(sims), F.lit(-1.0)).alias("sim"), tier_level(F.col("tier")).cast("double").alias("lvl")
    ).distinct()
    pcts = standing(base, "signal_source", "weight")
    b, p = base.alias("b"), pcts.alias("p")
    own = written(
        b.join(p, F.col("b.signal_source").eqNullSafe(F.col("p.signal_source")) & (F.col("b.weight") == F.col("p.weight")), "left").select(
            "b.sample_id", "b.triple_id", F.coalesce("p.pct", F.lit(-1.0)).alias("w"), "b.sim", "b.lvl"
        ),
        "fusion",
    )
    out = own
    for value, rank in (("w", "weight_rank"), ("sim", "similarity_rank"), ("lvl", "tier_rank")):
        o, r = out.alias("o"), ranks(own, "sample_id", value, rank).alias("r")
        out = o.join(r, F.col("o.sample_id").eqNullSafe(F.col("r.sample_id")) & (F.col(f"o.{value}") == F.col(f"r.{value}"))).select("o.*", f"r.{rank}")
    rrf = sum((F.lit(1.0) / (F.col(r) + RRF_K) for r in ("weight_rank", "similarity_rank", "tier_rank")), F.lit(0.0))
    return out.withColumn("rrf", rrf)


def top(kg: DataFrame, k: int = 5) -> DataFrame:
    """The k triples of each session with the highest rrf, ties by the smaller triple_id.

    Spark keeps k rows a session in each task before the shuffle, so a long session costs no more.
    """
    w = Window.partitionBy("sample_id").orderBy(F.desc("rrf"), "triple_id")
    return ranked(kg).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
