"""Readers of session files and tables. Schemas are declared; nothing is inferred but where none is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared schemas of the session tables, by name.
SCHEMAS = {
    "slides": "sample_id string, slide_id string, index int, image_file string, start_time double, end_time double, image_width int, image_height int, region_ids array<string>",
    "paper_chunks": "sample_id string, chunk_id string, page int, bbox array<int>, text string",
    "utterances": "sample_id string, utterance_id string, start_time double, end_time double, text string, enriched_text string, selected_tags array<string>, word_timestamps array<struct<text:string,start:double,end:double,duration:double>>",
    "gold": "sample_id string, session_id string, question string, answer string, answerable boolean, split string, source_type string, reasoning_pattern string",
}
_END = "struct<id:string,type:string,content:string>"
PROVENANCE = (
    "array<struct<source_type:string,start_time:double,end_time:double,slide_id:string,region_id:string,bbox:array<int>,chunk_id:string,page:int,"
    "chunk_text_preview:string,chart_type:string,is_repaired:boolean,repair_method:string,repaired_granularity:string,similarity_score:double>>"
)
TRIPLES = f"sample_id string, head {_END}, relation string, tail {_END}, provenance {PROVENANCE}, weight double, signal_source string, provenance_score double, tier string, is_repaired boolean"
METADATA = "session_id string, title string, authors array<string>, paper_url string, slides_data struct<slides:array<struct<time:double>>>"


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, conf, session_id, path, metadata) of every root/conf/session with a readable metadata.json.

    The session's id is the metadata's, or else what its folder's name has before the first underscore.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", True).text(root)
    parts = F.split("_metadata.file_path", "/")
    got = raw.select(F.from_json("value", METADATA, {"mode": "PERMISSIVE"}).alias("metadata"), parts.alias("p"), F.get_json_object("value", "$").alias("whole"))
    own = F.coalesce(F.nullif(F.trim("metadata.session_id"), F.lit("")), F.element_at(F.split(F.element_at("p", -2), "_"), 1))
    return got.where("whole is not null and metadata is not null").select(
        F.concat_ws("/", F.element_at("p", -3), own).alias("sample_id"), F.element_at("p", -3).alias("conf"), own.alias("session_id"),
        F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("path"), "metadata",
    )


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones, blank ones and those that are no object are skipped, or fail the read if strict."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = T._parse_datatype_string(schema)
    fields = [f.name for f in kind.fields]
    wide = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    got = rows.where(F.trim("value").startswith("{")).select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return got.where("r is not null and r._corrupt is null").select(*(F.col(f"r.`{f}`").alias(f) for f in fields))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))


def exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def triples(spark: SparkSession, root: str) -> DataFrame:
    """Triples of all sessions: kg_triples.jsonl, or kg_triples_trainable.jsonl if there is no such file at all.

    Rows without ids or contents are skipped; missing types, weights, tiers and provenance get defaults.
    """
    pattern = f"{root}/*/*/kg_triples.jsonl"
    if not exists(spark, pattern):
        pattern = f"{root}/*/*/kg_triples_trainable.jsonl"
    rows = json_lines(spark, pattern, TRIPLES)
    whole = rows.where(" and ".join(f"coalesce({e}.{f}, '') <> ''" for e in ("head", "tail") for f in ("id", "content")))
    end = lambda e: (F.col(f"{e}.id").alias(f"{e}_id"), F.coalesce(f"{e}.type", F.lit("Claim")).alias(f"{e}_type"), F.col(f"{e}.content").alias(f"{e}_content"))
    return whole.select(
        "sample_id", *end("head"), "relation", *end("tail"), F.coalesce("provenance", F.array().cast(PROVENANCE)).alias("provenance"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"), "signal_source", "provenance_score", F.coalesce("tier", F.lit("weak")).alias("tier"), F.coalesce("is_repaired", F.lit(False)).alias("is_repaired"),
    )


def last_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by order: later files and lines win."""
    data = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(data, F.struct(*order)).alias("r")).select("r.*")


def vector_map(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, v) of a JSON object from id to vector."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("node_id", "v"))


def edge_scores(spark: SparkSession, path: str) -> DataFrame:
    """(head_id, relation, tail_id, score) of a JSON object from 'head|relation|tail' to score; other keys are dropped."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("k", "score"))
    p = F.split("k", r"\|", -1)
    return raw.where(F.size(p) == 3).select(p[0].alias("head_id"), p[1].alias("relation"), p[2].alias("tail_id"), "score")


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """(session_path, file): one audio file a session, mp3 before m4a before wav."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp3,m4a,wav}").option("recursiveFileLookup", True).load(root).select("path")
    rank = F.when(F.col("path").endswith(".mp3"), 0).when(F.col("path").endswith(".m4a"), 1).otherwise(2)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return f.groupBy(folder.alias("session_path")).agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("file"))


def with_audio(all_sessions: DataFrame, audio: DataFrame) -> DataFrame:
    """Sessions that have audio; nothing is deleted."""
    return all_sessions.join(audio.select(F.col("session_path").alias("path")), "path", "left_semi")


def png_size(content: Column) -> tuple[Column, Column]:
    """(width, height) from a PNG's header; 1000 x 1000 for anything else."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    n = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(png, n(17)).otherwise(1000), F.when(png, n(21)).otherwise(1000)


def page_estimate(content: Column) -> Column:
    """Pages of a PDF by its page objects, 5000 at most; 0 if none is readable."""
    text = F.decode(content, "ISO-8859-1")
    return F.least(F.lit(5000), F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]")))


def inputs(tables: dict[str, DataFrame], needed: list[str], key: str = "sample_id") -> DataFrame:
    """Sessions that have rows in every needed table; a session that lacks one fails the job, and is named."""
    ids = [tables[n].select(key).distinct().withColumn(f"has_{n}", F.lit(True)) for n in needed]
    out = ids[0]
    for d in ids[1:]:
        out = out.join(d, key, "full")
    lack = F.array_compact(F.array(*(F.when(F.col(f"has_{n}").isNull(), F.lit(n)) for n in needed)))
    return out.select(F.when(F.size(lack) > 0, F.raise_error(F.concat(F.col(key), F.lit(" lacks "), F.array_join(lack, ", ")))).otherwise(F.col(key)).alias(key))


def evidence_links(spark: SparkSession, root: str, item: str) -> DataFrame:
    """(sample_id, node_id, ...) of all sessions' evidence_links.json: one object a session whose ``node_evidence`` maps are
    exploded; of a node that several files or places name the last one wins. item: schema of one node's evidence."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "evidence_links.json").option("recursiveFileLookup", True).text(root)
    made = raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"sample_id string, node_evidence array<struct<node_id:string,{item}>>").alias("r"))
    rows = made.select("file", "r.sample_id", F.posexplode("r.node_evidence").alias("pos", "n")).select("file", "pos", "sample_id", "n.*").where("trim(coalesce(node_id, '')) <> ''")
    return last_per_key(rows, "node_id", ["file", "pos"]).drop("file", "pos")


def raw_sessions(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, path) of download folders named by a number, an underscore and anything; of folders of one number the last by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    folder = F.regexp_extract("path", r"^(.*/([0-9]+)_[^/]*)/[^/]+$", 1)
    return files.select(folder.alias("path"), F.regexp_extract("path", r"/([0-9]+)_[^/]*/[^/]+$", 1).alias("session_id")).where("session_id <> ''").groupBy("session_id").agg(F.max("path").alias("path"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(session_path, n, path) of the page and slide images below a folder, numbered in order of name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", True).load(root).select("path")
    from pyspark.sql import Window

    folder = F.regexp_replace("path", "/[^/]*$", "")
    return f.withColumn("session_path", folder).withColumn("n", F.row_number().over(Window.partitionBy("session_path").orderBy("path")) - 1).select("session_path", "n", "path")


def graph_index(spark: SparkSession, root: str, names: tuple[str, ...] = ("entities", "relationships", "communities", "community_reports", "text_units"), optional: tuple[str, ...] = ("covariates",)) -> dict[str, DataFrame]:
    """The tables of a third-party graph index, Parquet files by name; a missing one fails and is named, optional ones may be absent."""
    lack = [n for n in names if not exists(spark, f"{root}/{n}.parquet")]
    if lack:
        raise FileNotFoundError(f"{root} lacks {', '.join(lack)}")
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in (*names, *(o for o in optional if exists(spark, f"{root}/{o}.parquet")))}


def indexed_sessions(spark: SparkSession, cache: str) -> DataFrame:
    """(session_id) whose index is in a cache written by writers.index_cache()."""
    if not exists(spark, f"{cache}/session_id=*"):
        return spark.createDataFrame([], "session_id string")
    return spark.read.parquet(cache).select(F.col("session_id").cast("string").alias("session_id")).distinct()


def questions(spark: SparkSession, path: str, schema: str, most: int = 0) -> DataFrame:
    """Questions of a file of JSON lines, the first ``most`` in order of file and place (0: all)."""
    rows = json_lines(spark, path, schema)
    return rows.limit(most) if most else rows


def vector_table(spark: SparkSession, path: str, ids: str | None = None) -> DataFrame:
    """(node_id, v): vectors of a Parquet table (node_id, v), or of .npy files whose row numbers a JSON map from number to id names."""
    if not path.endswith(".npy"):
        return spark.read.parquet(path).select("node_id", "v")
    import io

    import numpy as np
    import pandas as pd

    def rows(parts):
        for part in parts:
            for content in part["content"]:
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                yield pd.DataFrame({"i": np.arange(len(a)), "v": list(a.astype("float32"))})

    v = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "i bigint, v array<float>")
    names = spark.read.option("wholetext", True).text(ids).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "node_id"))
    return v.join(names.withColumn("i", F.col("k").cast("bigint")), "i").select("node_id", "v")


def rendered_pages(files: DataFrame, key: str, content: str, out: str, renderer) -> DataFrame:
    """(key, page, path) of PDFs drawn as images by a provider, bytes -> list of PNG bytes, into a folder of its own, never
    the source's; files it fails at have none. A task that is run again writes the same names."""
    import os

    import pandas as pd

    def run(parts):
        for part in parts:
            rows = []
            for k, c in zip(part[key], part[content]):
                try:
                    drawn = renderer(bytes(c))
                except Exception:  # noqa: BLE001
                    continue
                for n, png in enumerate(drawn, 1):
                    path = f"{out}/{k}/page_{n:03d}.png"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "wb") as f:
                        f.write(png)
                    rows.append((k, n, path))
            yield pd.DataFrame(rows, columns=[key, "page", "path"])

    return files.select(key, content).mapInPandas(run, f"`{key}` string, page int, path string")
