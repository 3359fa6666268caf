"""Column functions on vectors held as arrays of numbers; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    ))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where either vector has length 0 or a component that is not finite.

    Known lengths can be passed in.
    """
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    found = F.try_divide(dot(a, b), lengths)
    return F.when(lengths < F.lit(float("inf")), F.coalesce(found, F.lit(0.0))).otherwise(F.lit(0.0))


def relevance(similarity: Column) -> Column:
    """Similarity as a score from 0 to 1 with four decimals."""
    return F.round(F.greatest(F.lit(0.0), similarity), 4)


def vector_or_zero(v: Column | str, dim: int) -> Column:
    """The vector, or the zero vector where there is none."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.coalesce(F.col(v) if isinstance(v, str) else v, zeros)
