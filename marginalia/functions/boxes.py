"""Box algebra on structs of x1, y1, x2, y2; a null box has no area and meets nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), hi - lo)


def area(b: Column) -> Column:
    return F.coalesce(_side(b["x1"], b["x2"]) * _side(b["y1"], b["y2"]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = _side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"]))
    h = _side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(w * h)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    return _share(i, area(a) + area(b) - i)


def inside(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return _share(intersection(inner, outer), area(inner))


def smaller_overlap(a: Column, b: Column) -> Column:
    """Intersection by the smaller area."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def clip(b: Column, width: Column, height: Column) -> Column:
    """A box within its page; null where nothing is left or the page is unknown."""
    x1, x2 = F.greatest(F.lit(0.0), F.least(b["x1"], width)), F.greatest(F.lit(0.0), F.least(b["x2"], width))
    y1, y2 = F.greatest(F.lit(0.0), F.least(b["y1"], height)), F.greatest(F.lit(0.0), F.least(b["y2"], height))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def scale(b: Column, fx: Column, fy: Column) -> Column:
    return F.when(b.isNotNull(), F.struct((b["x1"] * fx).alias("x1"), (b["y1"] * fy).alias("y1"), (b["x2"] * fx).alias("x2"), (b["y2"] * fy).alias("y2")))


def text(b: Column) -> Column:
    """The four values with two decimals."""
    return F.when(b.isNull(), "").otherwise(F.format_string("%.2f, %.2f, %.2f, %.2f", b["x1"], b["y1"], b["x2"], b["y2"]))
