"""Bounding-box algebra as Column expressions: top-left origin, y grows down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x0, y0, x1, y1 with a prefix."""
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    """Area that both boxes cover."""
    zero = F.lit(0.0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def overlaps(a: Box, b: Box) -> Column:
    """Whether boxes share area; touching edges don't."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlap_of_first(a: Box, b: Box) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Share of the smaller box that both cover."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def pad_and_clamp(b: Box, padding: float, width: Column, height: Column) -> Box:
    """The box grown by a padding, inside the page."""
    p, zero = F.lit(padding), F.lit(0.0)
    return F.greatest(b[0] - p, zero), F.greatest(b[1] - p, zero), F.least(b[2] + p, width), F.least(b[3] + p, height)


def media_fingerprint(b: Box, width: Column, height: Column) -> Column:
    """Five small numbers that tell repeated media: centre and size in tenths of the page, and the edge band."""
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    tenth = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 10).cast("int")
    band = F.when(b[3] <= height * F.lit(0.18), 0).when(b[1] >= height * F.lit(0.84), 1).otherwise(2)
    return F.struct(tenth((b[0] + b[2]) / 2 / w).alias("x"), tenth((b[1] + b[3]) / 2 / h).alias("y"), tenth((b[2] - b[0]) / w).alias("w"), tenth((b[3] - b[1]) / h).alias("h"), band.alias("band"))
