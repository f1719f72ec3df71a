"""References to records that do not exist, found with bitmaps per key range and period.

Keys of all tables are dictionary-encoded as integers in key order, so that the keys of one session
share a key range; a key's code is the number of its first row, so codes have gaps. For each range
(2**15 codes) and period (a day) there is a bitmap of the codes referenced, of the codes born and of those
withdrawn. Going through a range's periods in order,
``referenced AND NOT (born before the period and not withdrawn by its end)`` leaves the bits that may be
orphans; only these are decoded, and their time stamps compared one by one.

Sizes: a bitmap is 4 KB at most and sparse ones are kept as arrays of 16-bit positions; one task holds
the bitmaps of one key range, so a key that a third of all rows refer to costs one bit a period.
Days and versions of a key stay rows: nothing is gathered into a set or an array per key, as Spark holds
those as objects whose memory runs out on large tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

#: Codes of one key range: what Spark's bitmap functions put in one bitmap.
RANGE_BITS = 15
#: A bitmap with fewer bits than this is kept as an array of positions.
SPARSE = 1024
#: Type of a node -> the table that has to hold its id (fixed values).
KIND_OF_TYPE = {
    "Slide": "slide",
    "VisualRegion": "region",
    "PaperChunk": "chunk",
    "Utterance": "utterance",
    "Claim": "node",
    "Method": "node",
    "Dataset": "node",
    "Metric": "node",
    "Result": "node",
    "Limitation": "node",
}


def kind_of(node_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in KIND_OF_TYPE.items():
        out = F.when(node_type == name, kind).otherwise(out)
    return out


def triple_refs(kg: DataFrame) -> DataFrame:
    """Both end points of every triple whose type names a table."""
    ends = F.array(*(
        F.struct(F.lit(f"{e}_id").alias("ref_field"), kind_of(F.col(f"{e}_type")).alias("kind"), F.col(f"{e}_id").alias("ref_id"))
        for e in ("head", "tail")
    ))
    return (
        kg.select(F.col("triple_id").cast("string").alias("source_key"), F.col("written_at").alias("at"), F.explode(ends).alias("e"))
        .where("e.kind is not null and e.ref_id is not null")
        .select(F.lit("kg_triples").alias("source_table"), "source_key", "e.ref_field", "e.kind", "e.ref_id", "at")
    )


def region_refs(links: DataFrame) -> DataFrame:
    """The regions inside evidence_links; withdrawn links count, null ids do not."""
    return (
        links.select(F.col("node_id").alias("source_key"), F.col("written_at").alias("at"), F.explode("visual_regions.region_id").alias("ref_id"))
        .where("ref_id is not null")
        .select(F.lit("evidence_links").alias("source_table"), "source_key", F.lit("region_id").alias("ref_field"), F.lit("region").alias("kind"), "ref_id", "at")
    )


def parents(slides: DataFrame, regions: DataFrame, chunks: DataFrame, utterances: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, born, gone) of every row that can be referred to."""
    never = F.lit(None).cast("timestamp_ntz")
    parts = [
        slides.select(F.lit("slide").alias("kind"), F.col("slide_id").alias("id"), F.col("written_at").alias("born"), never.alias("gone")),
        regions.select(F.lit("region"), "region_id", "written_at", "deleted_at"),
        chunks.select(F.lit("chunk"), "chunk_id", "written_at", "deleted_at"),
        utterances.select(F.lit("utterance"), "utterance_id", "written_at", never),
        links.select(F.lit("node"), "node_id", "written_at", "deleted_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("id is not null")


def versions(rows: DataFrame) -> DataFrame:
    """Of an id's rows that end at the same time only the one born first: wherever another holds, it does too."""
    kept = rows.groupBy("kind", "id", "gone").agg(F.min("born").alias("born"), F.max(F.col("born").isNull()).alias("always"))
    return kept.select("kind", "id", F.when(~F.col("always"), F.col("born")).alias("born"), "gone")


def marks(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per mark of a key, with the key's integer code and whether it has a version (held): a version
    (born, gone), or a day it is referred to (null for references without a time).

    A hot key is collapsed to its days, a parent to its ends, before the shuffle.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    days = refs.select("kind", F.col("ref_id").alias("id"), F.to_date("at").alias("day")).distinct()
    both = days.select("*", F.lit(False).alias("version"), no_time.alias("born"), no_time.alias("gone")).union(
        versions(rows).select("kind", "id", F.lit(None).cast("date"), F.lit(True), "born", "gone")
    )
    numbered = both.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").withColumn("n", F.monotonically_increasing_id())
    key = Window.partitionBy("kind", "id")
    return numbered.select("kind", "id", F.min("n").over(key).alias("code"), F.max("version").over(key).alias("held"), "day", "version", "born", "gone")


def bitmaps(keys: DataFrame) -> DataFrame:
    """(key_range, day, role, bits): what is referred to, born and withdrawn, packed.

    The marks are shuffled, not their bitmaps: those are made one after the other from sorted marks and packed
    at once. In a shuffle they compress so well that one task would be given, and sort, very many of them.
    """
    born = F.when(F.col("version"), F.coalesce(F.to_date("born"), F.lit("0001-01-01").cast("date")))
    roles = F.array(*(F.struct(F.lit(r).alias("role"), d.alias("day")) for r, d in (("ref", F.col("day")), ("born", born), ("gone", F.to_date("gone")))))
    made = (
        keys.select(F.shiftright("code", RANGE_BITS).alias("key_range"), (F.col("code") % (1 << RANGE_BITS)).alias("pos"), F.explode(roles).alias("m"))
        .where("m.day is not null")
        .repartition("key_range")
        .groupBy("key_range", "m.role", "m.day")
        .agg(F.expr("bitmap_construct_agg(pos)").alias("bits"))
    )
    return made.mapInPandas(_pack, "key_range long, role string, day date, bits binary")


def _pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        part["bits"] = [pack(b) for b in part["bits"]]
        yield part


def pack(bits: bytes) -> bytes:
    """An array of 16-bit positions for a sparse bitmap, the bitmap itself for a dense one."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return b"a" + at.astype("<u2").tobytes() if len(at) < SPARSE else b"b" + bits


def unpack(packed: bytes) -> np.ndarray:
    """Back to 2**15 truth values."""
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little").astype(bool)
    out = np.zeros(1 << RANGE_BITS, bool)
    out[np.frombuffer(packed, "<u2", offset=1)] = True
    return out


def _survivors(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Of one key range: the bits of ``referenced AND NOT in place``, decoded to codes, by day."""
    born, gone = np.zeros(1 << RANGE_BITS, bool), np.zeros(1 << RANGE_BITS, bool)
    codes, days = [], []
    for day, rows in part.sort_values("day").groupby("day", sort=False):
        roles = {r: unpack(b) for r, b in zip(rows["role"], rows["bits"])}
        if "gone" in roles:
            gone |= roles["gone"]
        if "ref" in roles:
            left = np.flatnonzero(roles["ref"] & ~(born & ~gone))
            codes.append(left + (int(key[0]) << RANGE_BITS))
            days += [day] * len(left)
        if "born" in roles:  # a parent born on the day itself may be later than the reference: left to the decoder
            born |= roles["born"]
    # without a survivor the list of days would become a column of doubles, which Arrow does not take for dates
    return pd.DataFrame({"code": np.concatenate(codes) if codes else np.zeros(0, np.int64), "day": pd.Series(days, dtype=object)})


def orphans(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs (source_table, source_key, ref_field, kind, ref_id, at) without a parent in rows
    (kind, id, born, gone) at the time ``at``, with status and period.

    status: missing (no such row), late (all its rows were written after ``at``), deleted (written in
    time, but every such row was withdrawn at or before ``at``). Ids are compared as exact strings.
    A parent without a time counts as always there; a reference without one can only be missing, and its
    period is null. Repeated rows give one result row. Empty tables give an empty result.
    """
    keys = written(marks(refs, rows), "orphan-keys", group_mb=16)
    left = bitmaps(keys).groupBy("key_range").applyInPandas(_survivors, "code long, day date").withColumnRenamed("day", "on")
    suspects = (  # the versions of a key, or one row without any
        left.join(keys, "code")
        .where("version or (not held and day = on)")
        .select("kind", F.col("id").alias("ref_id"), F.col("on").alias("day"), "version", "born", "gone")
        .union(keys.where("day is null and not held").select("kind", "id", "day", "version", "born", "gone"))
    )
    at_day = refs.withColumn("day", F.to_date("at")).alias("r")
    s = suspects.alias("s")
    joined = at_day.join(s, (F.col("r.kind") == F.col("s.kind")) & (F.col("r.ref_id") == F.col("s.ref_id")) & F.col("r.day").eqNullSafe(F.col("s.day")))
    in_time = F.col("s.version") & (F.col("s.born").isNull() | (F.col("s.born") <= F.col("r.at")))
    alive = F.col("s.gone").isNull() | (F.col("s.gone") > F.col("r.at"))
    judged = joined.groupBy("r.source_table", "r.source_key", "r.ref_field", "r.kind", "r.ref_id", "r.at").agg(
        F.max("s.version").alias("held"), F.max(in_time).alias("in_time"), F.max(in_time & alive).alias("fine")
    )
    status = F.when(~F.col("held"), "missing").when(~F.col("in_time"), "late").otherwise("deleted")
    return judged.where("not held or not fine").select("source_table", "source_key", "ref_field", "ref_id", status.alias("status"), F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, status and period."""
    return found.groupBy("source_table", "ref_field", "status", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_ids"))
