"""Box geometry as column expressions.

A box is four columns named by a prefix: ``box("a")`` is ``a_l, a_b, a_r, a_t``; without prefix
``l, b, r, t``. Everything stays inside code generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class BoxColumns(NamedTuple):
    l: Column  # noqa: E741
    b: Column
    r: Column
    t: Column


def box(prefix: str = "") -> BoxColumns:
    p = f"{prefix}_" if prefix else ""
    return BoxColumns(*(F.col(p + c) for c in "lbrt"))


def width(a: BoxColumns) -> Column:
    return F.greatest(a.r - a.l, F.lit(0.0))


def height(a: BoxColumns) -> Column:
    return F.greatest(a.t - a.b, F.lit(0.0))


def area(a: BoxColumns) -> Column:
    return width(a) * height(a)


def union(a: BoxColumns, b: BoxColumns) -> BoxColumns:
    return BoxColumns(F.least(a.l, b.l), F.least(a.b, b.b), F.greatest(a.r, b.r), F.greatest(a.t, b.t))


def union_all(a: BoxColumns) -> list[Column]:
    """Aggregates for the hull of a group."""
    return [F.min(a.l).alias("l"), F.min(a.b).alias("b"), F.max(a.r).alias("r"), F.max(a.t).alias("t")]


def beside(a: BoxColumns, b: BoxColumns) -> Column:
    return (a.b < b.t) & (b.b < a.t)


def center_x(a: BoxColumns) -> Column:
    return (a.l + a.r) / 2


def center_y(a: BoxColumns) -> Column:
    return (a.b + a.t) / 2


def holds_center(a: BoxColumns, b: BoxColumns) -> Column:
    return center_x(b).between(a.l, a.r) & center_y(b).between(a.b, a.t)


def intersection(a: BoxColumns, b: BoxColumns) -> Column:
    return F.greatest(F.least(a.r, b.r) - F.greatest(a.l, b.l), F.lit(0.0)) * F.greatest(F.least(a.t, b.t) - F.greatest(a.b, b.b), F.lit(0.0))


def iou(a: BoxColumns, b: BoxColumns) -> Column:
    both = intersection(a, b)
    all_ = area(a) + area(b) - both
    return F.when(all_ <= 0, F.lit(0.0)).otherwise(both / all_)


def giou(a: BoxColumns, b: BoxColumns) -> Column:
    around, all_ = area(union(a, b)), area(a) + area(b) - intersection(a, b)
    return F.when(around <= 0, F.lit(0.0)).otherwise(iou(a, b) - (around - all_) / around)


def horizontal_gap(a: BoxColumns, b: BoxColumns) -> Column:
    return F.greatest(F.greatest(a.l, b.l) - F.least(a.r, b.r), F.lit(0.0))


def vertical_overlap(a: BoxColumns, b: BoxColumns) -> Column:
    return F.greatest(F.least(a.t, b.t) - F.greatest(a.b, b.b), F.lit(0.0))


def touch(a: BoxColumns, b: BoxColumns, tol: float = 3.0) -> Column:
    return (a.r + tol >= b.l) & (b.r >= a.l - tol) & (a.t + tol >= b.b) & (b.t >= a.b - tol)


def is_rule(a: BoxColumns, kind: Column, stroked: Column) -> Column:
    w, h = width(a), height(a)
    return (kind == "stroke") & stroked & (((w <= 2) & (h >= 10)) | ((h <= 2) & (w >= 10)))


def is_flat(a: BoxColumns) -> Column:
    return width(a) >= height(a)


def margin_of(a: BoxColumns, page_height: Column) -> Column:
    return F.when(a.t >= page_height * 0.92, "header").when(a.b <= page_height * 0.08, "footer")


def from_coco(x: Column, y: Column, w: Column, h: Column, page_height: Column) -> BoxColumns:
    """A top-left ``x, y, w, h`` box in this library's orientation."""
    return BoxColumns(x, page_height - y - h, x + w, page_height - y)


def rescale(a: BoxColumns, x: Column, y: Column) -> BoxColumns:
    return BoxColumns(a.l * x, a.b * y, a.r * x, a.t * y)


def intersect_intervals(a: Column, b: Column) -> Column:
    """Non-empty intersections of all pairs of two arrays of ``struct<lo, hi>``."""
    pair = lambda x, y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi"))
    return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y)))), lambda i: i["lo"] < i["hi"])


def overlays(a: BoxColumns, a_size: Column, b: BoxColumns, b_size: Column) -> Column:
    both = intersection(a, b)
    return F.coalesce((a_size >= b_size * 2) & (both > 0) & (both / F.greatest(F.least(area(a), area(b)), F.lit(1.0)) >= 0.5), F.lit(False))


_SQL = {
    "box_area": ("l DOUBLE, b DOUBLE, r DOUBLE, t DOUBLE", "greatest(r - l, 0D) * greatest(t - b, 0D)"),
    "box_inter": ("l1 DOUBLE, b1 DOUBLE, r1 DOUBLE, t1 DOUBLE, l2 DOUBLE, b2 DOUBLE, r2 DOUBLE, t2 DOUBLE", "greatest(least(r1, r2) - greatest(l1, l2), 0D) * greatest(least(t1, t2) - greatest(b1, b2), 0D)"),
    "box_iou": ("l1 DOUBLE, b1 DOUBLE, r1 DOUBLE, t1 DOUBLE, l2 DOUBLE, b2 DOUBLE, r2 DOUBLE, t2 DOUBLE", "coalesce(box_inter(l1,b1,r1,t1,l2,b2,r2,t2) / nullif(box_area(l1,b1,r1,t1) + box_area(l2,b2,r2,t2) - box_inter(l1,b1,r1,t1,l2,b2,r2,t2), 0D), 0D)"),
}


def register(spark: SparkSession) -> None:
    """The geometry as SQL functions, which the optimizer inlines."""
    for name, (args, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
