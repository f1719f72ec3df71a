"""Column expressions over provenance items (arrays of structs); nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O

MODALITIES = ("audio", "slide", "paper")


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def modality(p: Column) -> Column:
    """audio, slide or paper, by the source type or else by the fields an item has; null if neither tells."""
    st = F.lower(text(p["source_type"]))
    return (
        F.when(st == "audio", "audio")
        .when(st.isin("slide", "slide_region", "visual_region"), "slide")
        .when(st.isin("paper", "paper_chunk", "figure", "table"), "paper")
        .when(p["slide_id"].isNotNull() | p["region_id"].isNotNull(), "slide")
        .when(p["chunk_id"].isNotNull() | p["page"].isNotNull(), "paper")
    )


def quality(p: Column) -> Column:
    """How well an item pins its place down: 1.0, 0.9 (found by dense retrieval), 0.6 or 0.0. Null ids count as empty."""
    m = modality(p)
    boxed = F.coalesce(F.size(p["bbox"]) == 4, F.lit(False))
    anchored = p["page"].isNotNull() | boxed
    chunk = text(p["chunk_id"]) != ""
    timed = F.coalesce(p["end_time"] > p["start_time"], F.lit(False)) & ~F.isnan(p["end_time"]) & ~F.isnan(p["start_time"])
    return (
        F.when(m == "audio", F.when(timed, 1.0).otherwise(0.6))
        .when(m == "slide", F.when((text(p["region_id"]) != "") & boxed, 1.0).when(text(p["slide_id"]) != "", 0.6).otherwise(0.0))
        .when(
            m == "paper",
            F.when(F.coalesce(p["is_repaired"], F.lit(False)) & (text(p["repair_method"]) == "dense_retrieval"), 0.9)
            .when(chunk & anchored, 1.0)
            .when(text(p["source_type"]).isin("figure", "table") & anchored, 1.0)
            .when(chunk | anchored, 0.6)
            .otherwise(0.0),
        )
        .otherwise(0.0)
    )


def items(prov: Column, m: str) -> Column:
    return F.filter(prov, lambda p: modality(p) == m)


def best(prov: Column, m: str) -> Column:
    """The best quality among the items of one modality, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(items(prov, m), quality)), F.lit(0.0))


def weight(relation: Column, m: str) -> Column:
    out = F.lit(0.0)
    for r, ws in O.WEIGHTS.items():
        out = F.when(relation == r, F.lit(ws[MODALITIES.index(m)])).otherwise(out)
    return out


def raw_score(relation: Column, prov: Column) -> Column:
    """Sum of weight times best quality over the modalities (audio, slide, paper, in this order), within 0 and 1."""
    total = weight(relation, "audio") * best(prov, "audio") + weight(relation, "slide") * best(prov, "slide") + weight(relation, "paper") * best(prov, "paper")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def repaired(prov: Column, own: Column) -> Column:
    return F.coalesce(own, F.lit(False)) | F.coalesce(F.exists(prov, lambda p: F.coalesce(p["is_repaired"], F.lit(False))), F.lit(False))


def tier(score: Column, prov: Column, is_repaired: Column) -> Column:
    """Tier of the unrounded score; strong falls to medium if an item was repaired for a whole page only."""
    page = F.exists(prov, lambda p: F.coalesce(p["is_repaired"], F.lit(False)) & (text(p["repaired_granularity"]) == "page_level") & modality(p).isNotNull())
    plain = F.when(score >= O.STRONG_MIN, "strong").when(score >= O.MEDIUM_MIN, "medium").otherwise("weak")
    return F.when(is_repaired & page & (plain == "strong"), "medium").otherwise(plain)
