"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; vectors of norm 1e-12 or less stay as they are."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 where either side is empty or null."""
    safe = F.coalesce(F.size(a), F.lit(0)) * F.coalesce(F.size(b), F.lit(0)) > 0
    return F.when(safe, dot(unit(a), unit(b))).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def ema(vectors: Column, keep: float = 0.9) -> Column:
    """Exponential moving average along an ordered array of vectors; the first
    starts it, the result is not normalised again."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x * keep + y * (1 - keep)))
