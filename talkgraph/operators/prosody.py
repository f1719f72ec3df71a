"""Prosody: tags of utterances by loudness, length, wording and pauses, their events and the marked-up text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O
from talkgraph.operators import timeline as L

#: How far above the recording's mean a tag begins, and the shortest event of the tags that are debounced (fixed values).
RAISED, SHORTEST = 1.5, 0.05
#: Tags that wrap a text, from the inside out (fixed values).
WRAPPING = ("DISFLUENCY", "RISING_TONE", "SLOW_DOWN", "STRESS")
_CANDIDATE = "array<struct<label:string,score:double,s:double,e:double,confidence:double>>"


def scored(utterances: DataFrame, pauses: DataFrame, loudness: DataFrame) -> DataFrame:
    """utterances (sample_id, utterance_id, s, e, text) with their place in the recording, a text for those without one,
    loudness and length as z-scores, and the nearest pause.

    loudness: sample_id, t, v; pauses: sample_id, ps, pe. Loudness is smoothed by a median over five utterances.
    """
    order = ["s", "utterance_id"]
    u = utterances.withColumn("i", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)) - 1)
    text = F.trim(F.coalesce("text", F.lit("")))
    u = u.withColumn("text", F.when(text == "", F.concat(F.lit("utterance_"), F.col("i").cast("string"))).otherwise(text))
    heard = L.range_average(u.select("sample_id", F.col("utterance_id").alias("span_id"), "s", "e"), loudness).select(F.col("span_id").alias("utterance_id"), F.col("mean").alias("energy"))
    u = u.join(heard, "utterance_id").withColumn("energy", L.median_filter(u, "sample_id", order, "energy")).withColumn("length", F.col("e") - F.col("s"))
    u = u.withColumn("z_energy", L.z_score("sample_id", "energy")).withColumn("z_length", L.z_score("sample_id", "length"))
    return u.join(L.nearest_pause(u.select("sample_id", "utterance_id", F.col("s").alias("us")), pauses).select("utterance_id", "pause_start", "pause_end"), "utterance_id", "left")


def candidates(scored_utterances: DataFrame) -> Column:
    """The tags an utterance may get with their score and span, in order of rule; too short ones of two tags are dropped."""
    pause = F.col("pause_end") - F.col("pause_start")
    one = lambda when, label, score, conf, s="s", e="e": F.when(when, F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), score.alias("score"), F.col(s).alias("s"), F.col(e).alias("e"), F.lit(conf).alias("confidence")))
    made = F.array_compact(F.array(
        one(F.col("z_energy") > RAISED, "STRESS", F.col("z_energy"), 0.7), one(F.col("z_length") > RAISED, "SLOW_DOWN", F.col("z_length"), 0.65),
        one(F.col("text").endswith("?"), "RISING_TONE", F.lit(1.6), 0.55), one(F.lower("text").rlike(O.DISFLUENCY), "DISFLUENCY", F.lit(1.9), 0.75),
        one(pause >= 0.2, F.when(pause >= 0.8, "PAUSE_LONG").otherwise("PAUSE"), F.when(pause >= 0.8, 1.7).otherwise(1.3), 0.8, "pause_start", "pause_end"),
    )).cast(_CANDIDATE)
    return F.filter(made, lambda c: ~((c["e"] - c["s"] < SHORTEST) & c["label"].isin("STRESS", "RISING_TONE")))


def marked(text: Column, chosen: Column) -> Column:
    """The text with a pause before it and its other tags around it."""
    has = lambda t: F.exists(chosen, lambda c: c["label"] == t)
    length = F.format_string("%.2f", F.element_at(F.filter(chosen, lambda c: c["label"].startswith("PAUSE")), 1)["e"] - F.element_at(F.filter(chosen, lambda c: c["label"].startswith("PAUSE")), 1)["s"])
    out = F.when(has("PAUSE_LONG"), F.concat(F.lit('<PAUSE dur="'), length, F.lit('" kind="long"/> '), text)).when(has("PAUSE"), F.concat(F.lit('<PAUSE dur="'), length, F.lit('"/> '), text)).otherwise(text)
    for t in WRAPPING:
        out = F.when(has(t), F.concat(F.lit(f"<{t}>"), out, F.lit(f"</{t}>"))).otherwise(out)
    return out


def tagged(utterances: DataFrame, pauses: DataFrame, loudness: DataFrame, most: int = 3) -> DataFrame:
    """(sample_id, utterance_id, s, e, text, tags, events, enriched_text): the best tags of each utterance, ``most`` at
    the most, earlier rules first on a tie."""
    u = scored(utterances, pauses, loudness)
    ranked = F.transform(F.array_sort(F.transform(candidates(u), lambda c, i: F.struct((-c["score"]).alias("o"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    u = u.withColumn("chosen", F.slice(ranked, 1, max(1, most)))
    event = lambda c, k: F.struct(F.concat(F.col("sample_id"), F.lit("/prosody/"), F.lower(c["label"]), F.format_string("/%04d_%02d", "i", k)).alias("event_id"), c["label"].alias("type"), F.round(c["s"], 3).alias("s"), F.round(c["e"], 3).alias("e"), F.round(F.least(F.lit(1.0), c["score"] / 3.0), 3).alias("intensity"), c["confidence"].alias("confidence"))
    return u.select("sample_id", "utterance_id", "s", "e", "text", F.transform("chosen", lambda c: c["label"]).alias("tags"), F.transform("chosen", event).alias("events"), marked(F.col("text"), F.col("chosen")).alias("enriched_text"))


def linked(tags: DataFrame, pauses: DataFrame) -> DataFrame:
    """Selected and raw events together, each with the utterance it belongs to and clamped into it."""
    own = tags.select("sample_id", F.explode("events").alias("v")).select("sample_id", "v.event_id", "v.s", "v.e")
    raw = L.pause_events(pauses).select("sample_id", "event_id", "s", "e")
    return L.linked_events(own.unionByName(raw), tags.select("sample_id", "utterance_id", F.col("s").alias("us"), F.col("e").alias("ue")))


def asked(text: Column, z_pitch: Column) -> Column:
    """A text that ends high is a question: its full stop becomes a question mark."""
    return F.when((z_pitch > RAISED) & ~F.rtrim(text).endswith("?"), F.concat(F.rtrim(F.rtrim(text), F.lit(".")), F.lit("?"))).otherwise(text)


def unheard(segments: DataFrame) -> DataFrame:
    """Utterances of speech segments (sample_id, start_time, end_time) whose words nobody has: numbered stand-ins."""
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("start_time", "end_time")) - 1
    return segments.select("sample_id", "start_time", "end_time", F.concat(F.lit("utterance_"), n.cast("string")).alias("text"))
