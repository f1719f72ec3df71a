"""Tables written to the folder all executors share, used to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset and one machine does all work (tests), a folder of our own."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="talkgraph-")
    return _made[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed again when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before us
        pass


def written(df: DataFrame, tag: str, group_mb: int = 128) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive the loss of any executor
    and non-deterministic columns (row numbers, partition ids) keep one value. group_mb: what each task
    holds in memory before it writes (Parquet's row group)."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("parquet.block.size", group_mb << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
