"""Regions of images: which are worth a look, what is said of them and the report on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O

# When grey levels count as blank or as of little structure.
UNIFORM, DYNAMIC_BLANK, SPREAD_BLANK = 0.985, 6.0, 2.5
STEP, EDGES_LOW, DYNAMIC_LOW, SPREAD_LOW = 24, 0.004, 18.0, 10.0


def worth_a_look(pixels: DataFrame) -> DataFrame:
    """(region_id, verdict) of grey levels (region_id, row, col, grey): blank, low_info or keep.

    Blank if one level has nearly all pixels, or if neither range nor spread is of note; low_info if there are hardly any
    steps between neighbours and little range. All of it is counted per level or by self-joins on the place.
    """
    levels = pixels.groupBy("region_id", "grey").agg(F.count("*").alias("c")).groupBy("region_id").agg((F.max("c") / F.sum("c")).alias("dominant"))
    spread = pixels.groupBy("region_id").agg(F.stddev_pop("grey").alias("sd"), F.percentile("grey", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    here = pixels.select("region_id", "row", "col", "grey")
    pair = here.select("region_id", "row", (F.col("col") + 1).alias("col"), F.col("grey").alias("other")).unionByName(here.select("region_id", (F.col("row") + 1).alias("row"), "col", F.col("grey").alias("other")))
    steps = here.join(pair, ["region_id", "row", "col"]).groupBy("region_id").agg((F.count_if(F.abs(F.col("grey") - F.col("other")) > STEP) / F.count("*")).alias("edges"))
    dynamic, edges = F.col("p")[1] - F.col("p")[0], F.coalesce("edges", F.lit(0.0))
    blank = (F.col("dominant") >= UNIFORM) | ((dynamic < DYNAMIC_BLANK) & (F.col("sd") < SPREAD_BLANK))
    low = (edges < EDGES_LOW) & (dynamic < DYNAMIC_LOW) & (F.col("sd") < SPREAD_LOW)
    return levels.join(spread, "region_id").join(steps, "region_id", "left").select("region_id", F.when(blank, "blank").when(low, "low_info").otherwise("keep").alias("verdict"))


def status(summary: Column) -> Column:
    """What came of a region: nothing, a summary that says nothing, or one of use."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    return F.when(s == "", "empty").when(s.rlike(O.UNINFORMATIVE), "template").otherwise("ok")


def report(regions: DataFrame, examples: int = 5) -> DataFrame:
    """Per session: regions, enriched ones and their share, failures by kind and some failed regions.

    regions: sample_id, region_id, status. Failures are counted per kind, and examples are cut per kind, before they meet in a session's row.
    """
    kinds = regions.groupBy("sample_id", "status").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("region_id")))), 1, examples).alias("x"))
    hist = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.concat_ws("=", "status", F.col("n").cast("string"))))), ",")
    g = kinds.groupBy("sample_id").agg(F.sum("n").alias("n_regions"), F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).alias("n_enriched"), hist.alias("failures"), F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, examples), ",").alias("examples"))
    return g.select("sample_id", "n_regions", "n_enriched", F.round(F.col("n_enriched") / F.greatest(F.lit(1), F.col("n_regions")), 4).alias("coverage"), "failures", "examples")


def all_regions(slides: DataFrame, paper: DataFrame) -> DataFrame:
    """Regions of slides and of paper pages as one table; columns that one side lacks are null."""
    return slides.withColumn("origin", F.lit("slide")).unionByName(paper.withColumn("origin", F.lit("paper")), allowMissingColumns=True)


def with_semantics(rows: DataFrame, semantics: DataFrame) -> DataFrame:
    """rows with summary, chart type and entities of their region, or the defaults; columns of these names are replaced."""
    s = semantics.where("region_id is not null").groupBy("region_id").agg(F.max(F.struct("visual_summary", "chart_type", "entities")).alias("s"))
    out = rows.drop("visual_summary", "chart_type", "entities").join(s, "region_id", "left")
    return out.select("*", F.coalesce("s.visual_summary", F.lit("")).alias("visual_summary"), F.coalesce("s.chart_type", F.lit("none")).alias("chart_type"), F.coalesce("s.entities", F.array().cast("array<string>")).alias("entities")).drop("s")


def described(regions: DataFrame, images: DataFrame, model, most_bytes: int = 4_000_000, cut=None) -> DataFrame:
    """(region_id, visual_summary, chart_type, entities, status) of regions (region_id, image, bbox) by a model over image bytes
    (image, content). cut (content, bbox, bytes) crops and shrinks and is a provider, as is model (bytes -> dict); without cut
    the whole image is sent. What is too large, missing or fails has a status and no summary."""

    def one(content, bbox) -> tuple:
        if content is None:
            return "", "none", [], "no image"
        try:
            data = bytes(content) if cut is None else cut(bytes(content), list(bbox), most_bytes)
            if len(data) > most_bytes:
                return "", "none", [], "too large"
            got = model(data)
            return str(got.get("summary", "")), str(got.get("chart_type", "none")), [str(x) for x in got.get("entities", [])], "ok"
        except Exception as e:  # noqa: BLE001
            return "", "none", [], f"failed: {type(e).__name__}"

    def run(parts):
        for part in parts:
            got = [one(c, b) for c, b in zip(part["content"], part["bbox"])]
            yield pd.DataFrame({"region_id": part["region_id"], **{c: [g[k] for g in got] for k, c in enumerate(("visual_summary", "chart_type", "entities", "status"))}})

    joined = regions.join(images, "image", "left").select("region_id", "bbox", "content")
    return joined.mapInPandas(run, "region_id string, visual_summary string, chart_type string, entities array<string>, status string")


def embedded(images: DataFrame, key: str, content: str, model) -> DataFrame:
    """(key, embedding) of images by a vision encoder, bytes -> list of numbers; images it fails at have null."""

    def run(parts):
        for part in parts:
            out = []
            for c in part[content]:
                try:
                    out.append([float(x) for x in model(bytes(c))])
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({key: part[key], "embedding": out})

    return images.select(key, content).mapInPandas(run, f"`{key}` {dict(images.select(key).dtypes)[key]}, embedding array<double>")
