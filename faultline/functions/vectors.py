"""Vector functions in double precision, components added from first to last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; an all-zero vector stays. The length is worked out once a vector."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return F.element_at(scaled, 1)
