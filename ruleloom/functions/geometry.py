"""Boxes as struct<x0, y0, x1, y1> of doubles, in fractions of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(col(c).cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def from_array(a: Column | str) -> Column:
    """Four numbers as a box; null for any other length."""
    a = col(a)
    return F.when(F.size(a) == 4, box(a[0], a[1], a[2], a[3]))


def from_polygon(a: Column | str) -> Column:
    """The box around x, y, x, y, ...; a zero box for no points."""
    a = col(a)
    xs, ys = F.filter(a, lambda _, i: i % 2 == 0), F.filter(a, lambda _, i: i % 2 == 1)
    zero = F.lit(0.0)
    return F.when(F.coalesce(F.size(a), F.lit(0)) >= 2, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(box(zero, zero, zero, zero))


def center_x(b: Column | str) -> Column:
    b = col(b)
    return F.coalesce((b["x0"] + b["x1"]) / 2, F.lit(0.0))


def center_y(b: Column | str) -> Column:
    b = col(b)
    return F.coalesce((b["y0"] + b["y1"]) / 2, F.lit(0.0))


def normalize(b: Column | str, width: Column, height: Column) -> Column:
    """Absolute to page fractions; a page without a size leaves the box as it is."""
    b = col(b)
    w, h = F.when(width > 0, width).otherwise(1.0), F.when(height > 0, height).otherwise(1.0)
    return box(b["x0"] / w, b["y0"] / h, b["x1"] / w, b["y1"] / h)


def denormalize(b: Column | str, width: Column, height: Column) -> Column:
    b = col(b)
    return box(b["x0"] * width, b["y0"] * height, b["x1"] * width, b["y1"] * height)


def center_inside(inner: Column | str, outer: Column | str, tolerance: float = 0.0) -> Column:
    o = col(outer)
    return center_x(inner).between(o["x0"] - tolerance, o["x1"] + tolerance) & center_y(inner).between(o["y0"] - tolerance, o["y1"] + tolerance)


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """The share of a that b covers; 0 for a box without area."""
    a, b = col(a), col(b)
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))
    return F.when(area > 0, w * h / area).otherwise(0.0)


def signature(page: Column, b: Column | str, digits: int = 6) -> Column:
    """Page and rounded corners: equal for boxes that can't be told apart."""
    b = col(b)
    return F.struct(page, *(F.round(b[n], digits).alias(n) for n in ("x0", "y0", "x1", "y1")))


def font_size(b: Column | str, page_height: Column) -> Column:
    """Points estimated from the box's height on a page measured in inches; null unless positive."""
    b = col(b)
    points = F.round((b["y1"] - b["y0"]) * page_height * 72, 1)
    return F.when(points > 0, points)
