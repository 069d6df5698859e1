"""Column functions over vectors stored as arrays.

Every sum runs in double precision; scores are rounded once, before ranking, so that
copies of a vector tie exactly and the tie then falls to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit-length float vector; null for a zero vector."""
    length = F.nullif(norm(v), F.lit(0.0))
    return F.when(
        length.isNotNull(),
        F.transform(as_double(v), lambda x: (x / length).cast("float")),
    )


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(score, digits)
