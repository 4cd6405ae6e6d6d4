"""Vector arithmetic on ARRAY<FLOAT> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 when the lengths differ or a norm is zero. Norms may be given precomputed."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    # A zero norm makes the quotient null; each part is evaluated once.
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))).otherwise(F.lit(0.0))
