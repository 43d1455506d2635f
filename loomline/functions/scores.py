"""Score arithmetic as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 where a length is zero, null where dimensions differ."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, 0.0).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0))))


def set_cosine(query: Column, words: Column) -> Column:
    """Shared different words over the geometric mean of both set sizes."""
    a, b = F.array_distinct(query), F.array_distinct(words)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(F.size(a), F.lit(1)).cast("double") * F.greatest(F.size(b), F.lit(1))))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(small, F.lit(1)).cast("double"))


def hybrid(semantic: Column, lexical: Column, weight: float = 0.6) -> Column:
    """Weighted sum where both arms found the row, else the one score."""
    return F.when(semantic.isNotNull() & lexical.isNotNull(), weight * semantic + (1 - weight) * lexical).otherwise(F.coalesce(semantic, lexical))


def recency_week(age_hours: Column) -> Column:
    return F.exp(-age_hours / 168)


def recency_half_year(age_days: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), age_days) / 180))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return part / F.nullif(whole, F.lit(0))
