"""Vector column functions, all of them native expressions (double accumulation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(x: Column) -> Column:
    """x rounded to the nearest half-precision number (ties to even); magnitudes from 65520 on become infinite."""
    x = x.cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    big = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x == 0, F.lit(0.0)).when(F.abs(x) >= 65520, big).otherwise(F.rint(x / unit) * unit).cast("float")


def half_vector(v: Column) -> Column:
    return F.transform(v, half)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
