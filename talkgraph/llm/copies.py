"""Records that differ only in formatting: commutative multiset hashing, then field equality.

A record's text columns are cut into fields (at ``;`` and ``|``), each field is normalised, and each
pair (column, field) hashed; the hashes of a column are added, which does not depend on their order.
Records are grouped by a fingerprint of 128 bits, and each member's fields are then compared with those
of its group's keeper as multisets, without sorting; whatever a hash collision put in a wrong group is
grouped once more by its exact fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgraph.functions.shared import written

#: Private characters that stand for parts of numbers while the rest is stripped.
_SIGN, _MINUS, _POINT = "\ue000", "\ue001", "\ue002"
#: White space, punctuation, symbols and controls, but none of those marks.
_GAP = rf"[\p{{Z}}\p{{C}}\s\p{{P}}\p{{S}}&&[^{_SIGN}{_MINUS}{_POINT}]]+"


def normal_text(c: Column) -> Column:
    """Text without letter case, white space and punctuation; a number's sign and decimal point stay.

    A gap between two digits stays as one space, so that "1 2" and "12" differ.
    """
    c = F.lower(c)
    c = F.regexp_replace(c, r"(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))", "")  # thousands
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}\p{M}.])[-−‐-—](?=[.]?\p{Nd})", _MINUS)
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}\p{M}.])[+](?=[.]?\p{Nd})", _SIGN)
    c = F.regexp_replace(c, rf"(?<![^\p{{Nd}}\s\p{{Z}}{_MINUS}{_SIGN}])[.](?=\p{{Nd}})", _POINT)
    c = F.regexp_replace(c, r"(?<=\p{Nd})" + _GAP + r"(?=\p{Nd})", " ")
    return F.regexp_replace(c, rf"(?<!\p{{Nd}}){_GAP}|{_GAP}(?!\p{{Nd}})", "")


def fields(c: Column) -> Column:
    """Normalised fields of a text, in any order; null for null, an empty list for a text without content."""
    return F.filter(F.transform(F.split(c, r"[;|]"), normal_text), lambda x: x != "")


def multiset_hash(column: str, pieces: Column, seed: int) -> Column:
    """Sum of 40-bit hashes of (column, field): it commutes, and 2**23 fields can't overflow it."""
    pair = lambda x: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(column), x), 24)
    return F.coalesce(F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: a + pair(x)), F.lit(-1).cast("bigint"))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two lists of fields hold the same fields equally often (null equals null only).

    Distinct fields are compared as sets; only where a field repeats are its copies counted.
    """
    counted = F.forall(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) == F.size(F.filter(b, lambda y: y == x)))
    sets = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    equal = (a == b) | ((F.size(a) == F.size(b)) & sets & ((F.size(F.array_distinct(a)) == F.size(a)) | counted))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def fingerprinted(df: DataFrame, id_col: str, exact: list[str], text: list[str]) -> DataFrame:
    """id, f1, f2 and, per text column, its fields. exact columns take part as they are."""
    own = df.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_x{i}") for i, c in enumerate(exact)), *(fields(F.col(c)).alias(f"_t{i}") for i, c in enumerate(text)))

    def mark(seed: int) -> Column:
        exacts = [F.coalesce(F.xxhash64(F.lit(seed), f"_x{i}"), F.lit(0)) + F.col(f"_x{i}").isNull().cast("int") for i in range(len(exact))]
        return F.xxhash64(F.lit(seed), *exacts, *(multiset_hash(c, F.col(f"_t{i}"), seed) for i, c in enumerate(text)), *(F.coalesce(F.size(f"_t{i}"), F.lit(-1)) for i in range(len(text))))

    return own.select("_id", *(f"_x{i}" for i in range(len(exact))), *(f"_t{i}" for i in range(len(text))), mark(11).alias("_f1"), mark(29).alias("_f2"))


def members(df: DataFrame, id_col: str, exact: list[str], text: list[str]) -> DataFrame:
    """(keep_id, id): each record that has a copy with a smaller id, and the smallest id of its group.

    Two records are copies if the exact columns are equal (null equals null) and each text column has the
    same normalised fields, in any order. A null text equals null only; a text without letters and digits
    equals every such text. Rows repeated under one id are one record. An empty table gives an empty result.

    Ids of a group are counted before they are shuffled (partial aggregation), so a group of a third of
    all rows is one row a task; the join back is an inner sort-merge join, whose large partitions Spark's
    adaptive execution splits.
    """
    marks = written(fingerprinted(df, id_col, exact, text).select("_id", "_f1", "_f2"), "copies-marks")
    groups = marks.groupBy("_f1", "_f2").agg(F.min("_id").alias("keep_id"), F.max("_id").alias("_last")).where("keep_id < _last").drop("_last")
    ids = written(marks.join(groups, ["_f1", "_f2"]).dropDuplicates(["_id", "_f1", "_f2"]), "copies-ids")
    # the fields are needed of records in groups only
    own = df.join(ids.select(F.col("_id").alias(id_col)).distinct(), id_col, "left_semi")
    grouped = written(fingerprinted(own, id_col, exact, text).join(ids, ["_id", "_f1", "_f2"]), "copies")
    keeper = grouped.where("_id = keep_id").dropDuplicates(["_f1", "_f2"]).select("_f1", "_f2", *(F.col(c).alias(f"k{c}") for c in grouped.columns if c[:2] in ("_x", "_t")))
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"_x{i}").eqNullSafe(F.col(f"k_x{i}")) for i in range(len(exact))] + [same_multiset(F.col(f"_t{i}"), F.col(f"k_t{i}")) for i in range(len(text))],
        F.lit(True),
    )
    judged = grouped.where("_id > keep_id").join(keeper, ["_f1", "_f2"]).withColumn("_same", same)
    fine = judged.where("_same").select("keep_id", "_id")
    # the exact way for collisions: the fields themselves as the key
    rest = judged.where("not _same").select("_id", *(f"_x{i}" for i in range(len(exact))), *(F.array_sort(f"_t{i}").alias(f"_t{i}") for i in range(len(text))))
    keys = [c for c in rest.columns if c != "_id"]
    again = rest.groupBy(*keys).agg(F.min("_id").alias("keep_id"))
    cond = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    late = rest.alias("r").join(again.alias("g"), cond).where("r._id > g.keep_id").select("g.keep_id", "r._id")
    return fine.union(late).distinct().select("keep_id", F.col("_id").alias(id_col))


def collapsed(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """df with one record of each group of copies, and n_copies, the number of records in its group."""
    n = found.groupBy(F.col("keep_id").alias(id_col)).agg(F.count("*").alias("__copies"))
    return df.dropDuplicates([id_col]).join(found, id_col, "left_anti").join(n, id_col, "left").withColumn("n_copies", 1 + F.coalesce("__copies", F.lit(0))).drop("__copies")
