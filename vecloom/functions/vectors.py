"""Vector arithmetic inside code generation: sums in double over float or double arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    """As doubles: folding in single precision drifts."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(wide(a), lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column, mismatch: str = "null") -> Column:
    """The cosine of two vectors.

    mismatch, for lengths that differ: `null`, `zero` (clustering: also for null vectors and zero norms), `raise`
    (null vectors and zero norms are 0), or `search` (null for lengths that differ, zero norms 0 by a small addend).
    """
    same = F.size(a) == F.size(b)
    if mismatch == "search":
        return F.when(same, dot(a, b) / (norm(a) * norm(b) + 1e-12))
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    if mismatch == "null":
        return F.when(same, value)
    if mismatch == "zero":
        return F.coalesce(F.when(same, value), F.lit(0.0))
    if mismatch == "raise":
        wrong = F.raise_error(F.concat(F.lit("vectors of lengths "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
        return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(~same, wrong).otherwise(F.coalesce(value, F.lit(0.0)))
    raise ValueError(f"unknown policy: {mismatch}")


def normalized(v: Column) -> Column:
    """Unit length in double, then single precision; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(wide(v), lambda x: x / n)).otherwise(wide(v)).cast("array<float>")


def unit_or_null(v: Column) -> Column:
    """Unit length in single precision; null for null, empty and zero vectors."""
    return F.when((F.size(v) > 0) & (norm(v) > 0), normalized(v))


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant; empty and non-finite ones are refused."""
    values = [float(x) for x in vector]
    if not values:
        raise ValueError("the query vector is empty")
    if not all(map(math.isfinite, values)):
        raise ValueError("the query vector has components that are not finite")
    return F.array(*map(F.lit, values))


def cosine_to(v: Column, query: Sequence[float], mismatch: str = "null") -> Column:
    """Cosine to a constant vector, whose norm is taken once, on the driver."""
    q = literal(query)
    own = math.sqrt(math.fsum(float(x) * float(x) for x in query))
    same = F.size(v) == len(query)
    if mismatch == "search":
        return F.when(same, dot(v, q) / (norm(v) * own + 1e-12))
    value = F.when(same, dot(v, q) / F.nullif(norm(v) * own, F.lit(0.0)))
    return F.coalesce(value, F.lit(0.0)) if mismatch == "zero" else value


def nearest_centroid(v: Column, centroids: np.ndarray) -> Column:
    """The number of the most similar centroid, the lowest among equals; centroids are a small constant matrix."""
    sims = F.array(*(cosine_to(v, c, "zero") for c in centroids))
    return F.array_position(sims, F.array_max(sims)).cast("int") - 1


def ndcg(gains: Sequence[float], ideal: Sequence[float], k: int) -> float:
    """Normalised discounted cumulative gain of the first k."""
    def total(xs: Sequence[float]) -> float:
        return sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(list(xs)[:k]))

    best = total(sorted(ideal, reverse=True))
    return total(gains) / best if best else 0.0


def nearest_rank(values: Sequence[float], f: float) -> float:
    """The value at place round(f * (n - 1)) of the sorted ones; 0 if there are none."""
    ordered = sorted(values)
    return ordered[round(f * (len(ordered) - 1))] if ordered else 0.0
