"""Boxes as structs of page_number, left, top, right, bottom; coordinates run down the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((a["page_number"] == b["page_number"]) & (w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 on different pages."""
    common = overlap_area(a, b)
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def center_distance(a: Column, b: Column) -> Column:
    """Distance of the centres over a's diagonal (1 at least), 1 at most; 1 on different pages."""
    dx = (a["left"] + a["right"] - b["left"] - b["right"]) / 2
    dy = (a["top"] + a["bottom"] - b["top"] - b["bottom"]) / 2
    size = F.greatest(F.hypot(width(a), height(a)), F.lit(1.0))
    return F.when(a["page_number"] != b["page_number"], 1.0).otherwise(F.least(F.hypot(dx, dy) / size, F.lit(1.0)))


def scaled(b: Column, page_width: Column, page_height: Column) -> Column:
    """A box in page pixels, from the size that it was measured at."""
    x = F.coalesce(F.try_divide(page_width, b["reference_width"]), F.lit(1.0))
    y = F.coalesce(F.try_divide(page_height, b["reference_height"]), F.lit(1.0))
    return F.struct(b["page_number"].alias("page_number"), (b["left"] * x).alias("left"), (b["top"] * y).alias("top"), (b["right"] * x).alias("right"), (b["bottom"] * y).alias("bottom"))


def canonical(page: Column, left: Column, top: Column, right: Column, bottom: Column, least: float = 1.0) -> Column:
    """Edges in order, not below 0 and ``least`` apart."""
    x0, y0 = F.greatest(F.least(left, right), F.lit(0.0)), F.greatest(F.least(top, bottom), F.lit(0.0))
    x1, y1 = F.greatest(F.greatest(left, right), x0 + least), F.greatest(F.greatest(top, bottom), y0 + least)
    return F.struct(page.alias("page_number"), x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"))


def font_size(field_height: Column, multiline: Column) -> Column:
    size = F.when(multiline, field_height * 0.68).otherwise(field_height * 0.75)
    return F.bround(F.least(F.greatest(size, F.lit(6.0)), F.lit(12.0)), 1)


def union(column: str) -> list[Column]:
    """Aggregates of the box around all boxes of a group."""
    return [F.min(f"{column}.left").alias("left"), F.min(f"{column}.top").alias("top"), F.max(f"{column}.right").alias("right"), F.max(f"{column}.bottom").alias("bottom")]
