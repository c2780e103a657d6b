"""Small array expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (lambdas would recompute it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))  # least and greatest skip nulls


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def nearest(row: Column, centroids: Column, tolerance: float) -> Column:
    """0-based index of the nearest centroid; within ``tolerance`` of the best the smallest index."""
    return let(
        F.transform(centroids, lambda c: distance(row, c)),
        lambda d: let(
            F.array_min(d),
            lambda best: F.array_position(F.transform(d, lambda x: (x - best) <= F.lit(tolerance)), F.lit(True)),
        ),
    ).cast("int") - F.lit(1)
