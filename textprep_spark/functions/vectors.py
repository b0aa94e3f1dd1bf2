"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY_MASK = 1e-9
TINY_NORM = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def _divided(v: Column, by: Column) -> Column:
    # A divisor inside a lambda is evaluated again per element; as an array it is evaluated once.
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, d: x / d)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a vector shorter than ``TINY_NORM`` is divided by that instead."""
    return _divided(v, F.greatest(norm(v), F.lit(TINY_NORM)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set: sum(vector * mask) / max(sum(mask), tiny)."""
    weights = mask.cast("array<double>")
    weighted = F.zip_with(tokens, weights, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(
        weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y)
    )
    count = F.greatest(total(weights), F.lit(TINY_MASK))
    return _divided(summed, count)
