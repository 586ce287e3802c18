"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """``x`` held between two bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def r6(x: Column) -> Column:
    """Round for reporting.  The tiny offset moves decimal ties off the rounding edge."""
    return F.round(x + F.lit(1e-10), 6)


def on_frame(t: Column, fps: Column | float) -> Column:
    """Time moved to the nearest frame, ties to the even frame."""
    return F.rint(t * fps) / fps


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0..180 degrees."""
    return F.abs(F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def strings(values) -> Column:
    vals = list(values)
    return F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<string>")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Constant map lookup that stays inside the expression tree."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, F.lit(default))


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
