"""Rectangles: columns ``x0, x1, top, bottom`` as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """The part of ``a`` that ``b`` covers."""
    return intersection(a, b) / F.nullif(area(a), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    x = intersection(a, b)
    return x / F.nullif(area(a) + area(b) - x, F.lit(0.0))
