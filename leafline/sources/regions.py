"""Boxes of layout models, in the shapes in which they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a prediction keeps its items, in the order in which they are looked for.
LISTS = ("bboxes", "boxes", "layout", "predictions")


def _number(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "double")


def region_edges(item: Column) -> Column:
    """struct left, top, right, bottom of one item (variant): four numbers of ``bbox``, the extent of ``polygon`` or ``points``, or x1 to y2; null for any other shape."""
    names = ("left", "top", "right", "bottom")
    edges = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, names, strict=True)])
    has = lambda path: F.try_variant_get(item, path, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(item, path, "variant"))
    listed = [F.try_variant_get(item, f"$.{name}", "array<array<double>>") for name in ("polygon", "points")]
    points = F.coalesce(*[F.when(F.size(x) > 0, x) for x in listed])
    whole = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(whole, lambda p: p[0]), F.transform(whole, lambda p: p[1])
    found = (
        F.when(has("$.bbox"), edges(*[_number(item, f"$.bbox[{i}]") for i in range(4)]))
        .when(F.size(whole) > 0, edges(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        .otherwise(edges(*[_number(item, f"$.{name}") for name in ("x1", "y1", "x2", "y2")]))
    )
    every = found["left"].isNotNull() & found["top"].isNotNull() & found["right"].isNotNull() & found["bottom"].isNotNull()
    return F.when(every, found)


def region_boxes(predictions: DataFrame) -> DataFrame:
    """doc_id, page_number, item, edges: the boxes of predictions (doc_id, page_number, payload, width, height) within their page.

    A payload is JSON: a list of items, or an object with one under ``LISTS``, of which the first that isn't empty counts. A box that isn't of one of the known shapes,
    or is empty once it is cut to the page, is left out, as is a payload that is no JSON.
    """
    payload = F.try_parse_json("payload")
    lists = [F.try_variant_get(payload, path, "array<variant>") for path in ("$", *(f"$.{name}" for name in LISTS))]
    items = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = predictions.select("doc_id", "page_number", "width", "height", F.posexplode(items).alias("item", "v")).withColumn("b", region_edges(F.col("v"))).where("b is not null")
    cut = lambda side, most: F.greatest(F.lit(0.0), F.least(F.col(f"b.{side}"), F.col(most).cast("double"))).alias(side)
    rows = rows.select("doc_id", "page_number", "item", cut("left", "width"), cut("top", "height"), cut("right", "width"), cut("bottom", "height"))
    return rows.where((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
