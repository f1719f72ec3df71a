"""Vector expressions over ARRAY<FLOAT>, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    once = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n))  # else the norm is taken for each element
    return F.element_at(once, 1)


def pooled(states: Column, mask: Column) -> Column:
    """Mean of token vectors, later ones weighing more: a token's weight is its place among those the mask keeps; zeros if it keeps none."""
    place = F.transform(F.sequence(F.lit(1), F.size(mask)), lambda i: F.aggregate(F.slice(mask, 1, i), F.lit(0.0), lambda a, x: a + x) * F.element_at(mask, i))
    total = F.aggregate(place, F.lit(0.0), lambda a, x: a + x)
    width = F.size(F.element_at(states, 1))
    summed = F.transform(F.sequence(F.lit(1), width), lambda d: F.aggregate(F.zip_with(states, place, lambda v, w: F.element_at(v, d).cast("double") * w), F.lit(0.0), lambda a, x: a + x))
    return F.transform(summed, lambda x: x / F.when(total == 0, 1.0).otherwise(total))
