"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine; 0 for empty or zero vectors and for different lengths. Norms may be given."""
    na, nb = na if na is not None else norm(a), nb if nb is not None else norm(b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))
