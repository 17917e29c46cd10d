"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty, zero or differently long vectors."""
    x, y = _d(a), _d(b)
    size = norm(x) * norm(y)
    return F.when((F.size(x) == F.size(y)) & (size > 0), dot(x, y) / size).otherwise(F.lit(0.0))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps from term to weight."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def is_usable(a: Column | str, dimensions: int | None = None) -> Column:
    """Finite components, and the dimension asked for."""
    x = _d(a)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return ok & (F.size(x) == dimensions) if dimensions else ok & (F.size(x) > 0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
