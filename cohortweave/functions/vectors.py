"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    """Single-precision vectors are widened before anything is computed with them."""
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def same_size(a: Column, b: Column) -> Column:
    """``a`` again, or a runtime error where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(
        F.raise_error(F.concat(F.lit("vector dimensions differ: "), F.size(a), F.lit(" and "), F.size(b))).cast(
            "array<double>"
        )
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    raw = dot(same_size(a, b), b) / size
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cosine``; a zero vector is at distance 1 of everything."""
    return 1.0 - cosine_similarity(a, b)


def similarity_to_distance(sim: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - sim)


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.transform(doubles(a), lambda x: x / F.when(size == 0, 1.0).otherwise(size))


def scale(value: Column, mean: Column, spread: Column) -> Column:
    return (value - mean) / spread


def stack(vector: Column, scaled: Column) -> Column:
    return F.concat(doubles(vector), F.array(scaled))


def logistic(features: Column, coef: Column, intercept: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(dot(features, coef) + intercept)))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def round6(value: Column) -> Column:
    """Six decimals; NaN and infinities become null."""
    inf = F.lit(float("inf"))
    bad = F.isnan(value) | (F.abs(value) == inf)
    return F.when(~bad, F.round(value, 6))
