"""Runs over sessions: what there is, what is left, manifests and summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgraph.functions.shared import written
from talkgraph.operators.learning import merge_manifests, resume
from talkgraph.sources import readers

_FILES = ("kg_triples.jsonl", "kg_triples_trainable.jsonl", "kg_quality_report.json", "pipeline_validation.json")


def recovered(spark: SparkSession, run: str, selected: DataFrame) -> DataFrame:
    """A manifest from what the sessions (sample_id) of a run have written: only sessions with triples count.

    Rows of triples and of trainable triples, quality status, whether validation passed and its errors; reports that are
    missing or broken give the defaults.
    """
    root = f"{run}/sessions/*/*"
    key = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -3), F.element_at(F.split("_metadata.file_path", "/"), -2))

    def rows(name: str, out: str) -> DataFrame:
        if not readers.exists(spark, f"{root}/{name}"):
            return spark.createDataFrame([], f"sample_id string, {out} bigint")
        lines = spark.read.text(f"{root}/{name}").select(key.alias("sample_id"), "value")
        return lines.groupBy("sample_id").agg(F.count_if(F.trim("value") != "").alias(out))

    def report(name: str, fields: str) -> DataFrame:
        if not readers.exists(spark, f"{root}/{name}"):
            return spark.createDataFrame([], f"sample_id string, {fields}")
        whole = spark.read.option("wholetext", True).text(f"{root}/{name}").select(key.alias("sample_id"), F.from_json("value", fields).alias("r"))
        return whole.select("sample_id", "r.*").dropDuplicates(["sample_id"])

    base = rows(_FILES[0], "triples").join(selected.select("sample_id").distinct(), "sample_id", "left_semi")
    out = base.join(rows(_FILES[1], "trainable"), "sample_id", "left").join(report(_FILES[2], "quality_status string"), "sample_id", "left").join(report(_FILES[3], "ok boolean, error_count bigint"), "sample_id", "left")
    return out.select("sample_id", "triples", F.coalesce("trainable", F.lit(0)).alias("triples_trainable"), F.trim(F.coalesce("quality_status", F.lit(""))).alias("status"), F.coalesce("ok", F.lit(True)).alias("validation_ok"), F.coalesce("error_count", F.lit(0)).alias("error_count"))


def manifest(written_rows: DataFrame, recovered_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Written and recovered rows of the selected sessions; written ones win."""
    ids = selected.select("sample_id").distinct()
    return merge_manifests(written_rows.join(ids, "sample_id", "left_semi"), recovered_rows.join(ids, "sample_id", "left_semi"), "sample_id")


def sampled(sessions: DataFrame, n: int = 0, seed: int = 42, limit: int = 0) -> DataFrame:
    """Sessions in order of id: a seeded sample of n (0: all), of which the first ``limit`` (0: all)."""
    out = sessions if not n else sessions.orderBy(F.md5(F.concat("sample_id", F.lit(f"|{seed}"))), "sample_id").limit(n)
    return out.orderBy("sample_id").limit(limit) if limit else out


def to_do(sessions: DataFrame, with_audio: DataFrame, done: DataFrame, n: int = 0, seed: int = 42, limit: int = 0) -> DataFrame:
    """(sample_id) of the sessions a run still has to do: those with audio, sampled and limited, without a finished row; failed coverage asks for another run."""
    ready = sessions.join(with_audio.select("sample_id").distinct(), "sample_id", "left_semi")
    return resume(sampled(ready, n, seed, limit), done, "sample_id")


def summary(done: DataFrame, failures: DataFrame, target: float = 0.9) -> DataFrame:
    """One row: sessions, failures, triples, their means, success rate and whether it is good enough."""
    a = done.agg(F.count("*").alias("succeeded"), F.coalesce(F.sum("triples"), F.lit(0)).alias("triples"), F.coalesce(F.sum("triples_trainable"), F.lit(0)).alias("trainable"), F.count_if(F.col("status") == "failed_coverage").alias("failed_coverage"))
    b = failures.agg(F.count("*").alias("failed"))
    rate = F.try_divide(F.col("succeeded"), F.col("succeeded") + F.col("failed"))
    return a.crossJoin(b).select("succeeded", "failed", "failed_coverage", "triples", "trainable", F.round(F.try_divide("triples", "succeeded"), 4).alias("triples_a_session"), F.round(rate, 4).alias("success_rate"), F.coalesce(rate >= target, F.lit(False)).alias("accepted"))


def write_object(row: DataFrame, path: str) -> None:
    """The one row of a small report as a JSON object in a file, invalid characters replaced."""
    spark = row.sparkSession
    text = json.dumps(json.loads(row.toJSON().first()), ensure_ascii=False, indent=2)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8", "replace")))
    out.close()


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The last run folder by name, null if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return f"{root}/{max(names)}" if names else None


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with its place ``i`` from 0 in an order: rows are sorted by range, and counts of the ranges before are added, so that no task has more than its range."""
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = at.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per range
    return at.join(F.broadcast(before), "_p").withColumn("i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_b")).drop("_p", "_b")


def shard_of(i: Column, shards: int) -> Column:
    return F.pmod(i, F.lit(shards))


def validation(utterances: DataFrame, events: DataFrame, triples: DataFrame, valid_triples: DataFrame) -> DataFrame:
    """Per session whether its records are sound: (sample_id, ok, error_count, tag_quota, no_tags, missing_link, bounds, invalid_triples).

    utterances: sample_id, utterance_id, s, e, tags, enriched_text; events: sample_id, event_id, s, e, utterance_id; triples and
    valid_triples: sample_id. Errors are counted per kind before they meet; a session without utterances has no tags.
    """
    own = utterances.groupBy("sample_id").agg(F.count_if(F.size("tags") > 2).alias("tag_quota"), (~F.coalesce(F.bool_or(F.col("enriched_text").rlike("<STRESS>|<PAUSE")), F.lit(False))).cast("int").alias("no_tags"))
    u = utterances.select("utterance_id", F.col("s").alias("us"), F.col("e").alias("ue")).dropDuplicates(["utterance_id"])
    ev = events.join(u, "utterance_id", "left").groupBy("sample_id").agg(F.count_if(F.col("us").isNull()).alias("missing_link"), F.count_if((F.col("us") > F.col("s")) | (F.col("s") > F.col("e")) | (F.col("e") > F.col("ue"))).alias("bounds"))
    n, v = triples.groupBy("sample_id").agg(F.count("*").alias("n")), valid_triples.groupBy("sample_id").agg(F.count("*").alias("v"))
    bad = n.join(v, "sample_id", "left").select("sample_id", (F.col("n") > F.coalesce("v", F.lit(0))).cast("int").alias("invalid_triples"))
    kinds = ("tag_quota", "no_tags", "missing_link", "bounds", "invalid_triples")
    out = own.join(ev, "sample_id", "full").join(bad, "sample_id", "full").fillna(0, list(kinds))
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return out.select("sample_id", (total == 0).alias("ok"), total.cast("bigint").alias("error_count"), *(F.col(k).cast("bigint").alias(k) for k in kinds))
