"""Text expressions: tokens, similarity, keys, sentences and windows; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgraph.functions import ontology as O


def tokens(c: Column) -> Column:
    """Distinct lower-case words of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1))


def token_hashes(c: Column) -> Column:
    """The distinct words of a text as 64-bit hashes, which take less room than the words."""
    return F.transform(tokens(c), lambda w: F.xxhash64(w))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the words of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def content_key(c: Column) -> Column:
    """Lower case, other signs as dashes, 120 characters at most, 'empty' for nothing."""
    k = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    k = F.substring(k, 1, 120)
    return F.when(k == "", "empty").otherwise(k)


def node_id(session: Column, kind: Column, key: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", session, kind, key)), 1, 12)


def sentences(c: Column) -> Column:
    strip = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def metric_terms(c: Column) -> Column:
    """The metric terms among a text's words, short ones in capitals, sorted."""
    own = tokens(c)
    terms = F.array(*(F.lit(t) for t in O.METRIC_TERMS))
    return F.array_sort(F.transform(F.filter(terms, lambda t: F.array_contains(own, t)), lambda t: F.when(F.length(t) <= 4, F.upper(t)).otherwise(t)))


def char_windows(c: Column, size: int = 500, lap: int = 100) -> Column:
    """(start, text) windows of a text; none of an empty one."""
    step = size - lap
    n = F.length(c)
    return F.when(n <= 0, F.array().cast("array<struct<start:int,text:string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: F.struct(i.cast("int").alias("start"), F.substring(c, i + 1, F.lit(size)).alias("text")))
    )


def packed(parts: Column, most: int = 900) -> Column:
    """Sentences packed greedily into chunks of at most ``most`` characters; a longer sentence is a chunk."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, s: Column) -> Column:
        fits = (a["cur"] == "") | (F.length(a["cur"]) + 1 + F.length(s) <= most)
        return F.struct(
            F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"),
            F.when(a["cur"] == "", s).when(fits, F.concat(a["cur"], F.lit(" "), s)).otherwise(s).alias("cur"),
        )

    return F.aggregate(parts, zero, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def too_noisy(c: Column) -> Column:
    """Whether a text is too full of signs to embed: empty, or long with few letters and digits or with dots of omission."""
    t = squeeze(F.coalesce(c, F.lit("")))
    n = F.length(t)
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    punct = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    soup = (n >= 120) & (alnum / n < 0.30) & (punct / n > 0.35)
    dots = (n >= 120) & F.contains(t, F.lit("…")) & (punct / n > 0.42)
    return (n == 0) | soup | dots


def question_relation(q: Column) -> Column:
    """The relation a question asks for, by the words in it."""
    low = F.lower(q)
    out = F.lit("supported_by")
    for relation, cues in reversed(O.QUESTION_CUES):
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(low, F.lit(c))
        out = F.when(hit, relation).otherwise(out)
    return out


def last_binary(c: Column) -> Column:
    """The last 0 or 1 in a text, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit("([01])"), 1), F.lit(-1))


def without_thinking(c: Column) -> Column:
    """What follows a closing thinking tag."""
    return F.trim(F.regexp_replace(c, r"(?s)^.*</think>", ""))


def semantic_windows(c: Column, most: int = 2200, lap: int = 250) -> Column:
    """Sentences packed into windows, each after the first led by the end of the window before it (without that one's own lead).

    A sentence longer than a window is cut into overlapping pieces.
    """
    t = squeeze(F.coalesce(c, F.lit("")))
    sents = F.filter(F.transform(F.split(t, r"(?<=[.!?。！？；;])\s+"), F.trim), lambda x: x != "")
    step = max(1, most - lap)
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(step)), lambda i: F.trim(F.substring(s, i + 1, F.lit(most))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(a: Column, s: Column) -> Column:
        flushed = F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        long_, fits = F.length(s) > most, F.length(a["cur"]) + 1 + F.length(s) <= most
        return F.struct(
            F.when(long_, F.concat(flushed, F.filter(pieces(s), lambda p: p != ""))).when((a["cur"] == "") | fits, a["done"]).otherwise(flushed).alias("done"),
            F.when(long_, "").when(a["cur"] == "", s).when(fits, F.concat(a["cur"], F.lit(" "), s)).otherwise(s).alias("cur"),
        )

    wins = F.aggregate(sents, zero, add, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
    led = F.transform(wins, lambda w, i: F.when(i == 0, w).otherwise(F.trim(F.concat(F.trim(F.right(F.element_at(wins, F.greatest(F.lit(1), i)), F.lit(lap))), F.lit(" "), w))))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(led)


def prompt(question: Column, context: Column) -> Column:
    """The prompt of an answering model: what it may use, then the question."""
    return F.concat(F.lit("Answer from the context only; say so if it does not hold the answer.\n"), F.coalesce(context, F.lit("")), F.lit("\nQuestion: "), question)
