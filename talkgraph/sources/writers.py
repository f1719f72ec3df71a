"""Writers of tables, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.make_valid_utf8(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def clean_strings(df: DataFrame) -> DataFrame:
    """Every string as valid UTF-8, also inside arrays and structs."""
    return df.select(*(_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    clean_strings(df).write.mode("append" if append else "overwrite").json(path)


def session_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table to its folder, one partition a session, all sessions in one job."""
    for name, df in tables.items():
        parts = df.withColumn("conf", F.substring_index("sample_id", "/", 1)).withColumn("session", F.substring_index("sample_id", "/", -1))
        parts.repartition("conf", "session").write.mode("overwrite").partitionBy("conf", "session").parquet(f"{root}/{name}")


def trainable(triples: DataFrame, path: str) -> None:
    """Strong and medium triples only."""
    triples.where(F.lower(F.trim("tier")).isin("strong", "medium")).write.mode("overwrite").parquet(path)


def split_tables(df: DataFrame, splits: DataFrame, path: str) -> None:
    """Rows of each split in a partition of its own."""
    df.join(splits, "sample_id").write.mode("overwrite").partitionBy("split").parquet(path)


def scores(df: DataFrame, path: str) -> None:
    """Edge scores as a table of four columns, rounded to six places."""
    df.select("head_id", "relation", "tail_id", F.round("score", 6).alias("score")).write.mode("overwrite").parquet(path)


def manifest(done: DataFrame, failures: DataFrame, root: str) -> None:
    """Manifest and failures in order of session; an empty list of failures leaves no file."""
    done.orderBy("sample_id").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    if failures.isEmpty():
        jvm, path = done.sparkSession.sparkContext._jvm, f"{root}/failures"
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(done.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    else:
        failures.orderBy("sample_id").coalesce(1).write.mode("overwrite").json(f"{root}/failures")


def supervision(rows: DataFrame, path: str) -> None:
    """Training rows by split, in order of session and key within each file."""
    rows.repartitionByRange("split", "sample_id", "sample_key").sortWithinPartitions("split", "sample_id", "sample_key").write.mode("overwrite").partitionBy("split").parquet(path)


def predictions(rows: DataFrame, path: str) -> None:
    """Predictions by seed and split."""
    rows.write.mode("overwrite").partitionBy("seed", "split").json(path)


def reranked(triples: DataFrame, report: DataFrame, path: str) -> None:
    """Reranked triples by split and session, and the report beside them."""
    triples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/triples")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def index_cache(vectors: DataFrame, path: str) -> None:
    """Vectors of sessions (session_id, ...), a folder a session; sessions written anew replace their own folders only."""
    vectors.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def dead_letters(rows: DataFrame, path: str) -> None:
    """What could not be handled, with the reason, appended."""
    clean_strings(rows).write.mode("append").json(path)


def model(fitted, path: str) -> None:
    """A fitted model or pipeline."""
    fitted.write().overwrite().save(path)
