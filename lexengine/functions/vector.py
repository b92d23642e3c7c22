"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(query: Column, row: Column, query_norm: Column | None = None, row_norm: Column | None = None) -> Column:
    """Cosine; a query of no length is not scaled, and a row's length counts as at least ``LEAST_NORM``."""
    q = query_norm if query_norm is not None else norm(query)
    r = row_norm if row_norm is not None else norm(row)
    return dot(query, row) / (F.when(q > LEAST_NORM, q).otherwise(F.lit(1.0)) * F.greatest(r, F.lit(LEAST_NORM)))


def or_zero(a: Column, dimension: int) -> Column:
    """The vector, or zeros where the embedding failed."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0).cast("float"), dimension))
