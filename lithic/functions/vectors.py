"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for empty vectors, unequal lengths and zero norms."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(F.lit(0.0))


def fitted(v: Column, dimension: int) -> Column:
    """Cut or padded with zeros to `dimension` components."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def hashed_embedding(text: Column, dimension: int) -> Column:
    """Stand-in embedding without a model: counts of words by hash, so equal texts have equal vectors."""
    slots = F.transform(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 1.0 if both are empty, 0.0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
