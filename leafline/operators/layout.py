"""Boxes against boxes: overlaps, alignment, nearest and previous neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def overlapping_pairs(fields: DataFrame, least: float = 0.04) -> DataFrame:
    """doc_id, a, b, iou of boxes on one page that overlap by more than ``least``; fields: doc_id, ord, name, box.

    Only boxes that share a horizontal band of 64 units of a page are compared: a box enters each band
    it crosses, and a pair counts in the first band that both cross.
    """
    band = lambda edge: F.floor(F.col(f"box.{edge}") / 64)
    rows = fields.where("box is not null").select("doc_id", "ord", "name", "box", F.col("box.page_number").alias("page"), band("top").alias("first"), F.explode(F.sequence(band("top"), F.greatest(band("top"), band("bottom")))).alias("band"))
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("doc_id", "page", "band")]
    pairs = x.join(y, [*same, F.col("x.ord") < F.col("y.ord"), F.col("x.band") == F.greatest("x.first", "y.first")])
    return pairs.select(F.col("x.doc_id").alias("doc_id"), F.col("x.name").alias("a"), F.col("y.name").alias("b"), g.iou(F.col("x.box"), F.col("y.box")).alias("iou")).where(F.col("iou") > least)


def tiny_fields(fields: DataFrame) -> DataFrame:
    box = F.col("box")
    return fields.where("box is not null").where((g.width(box) < 15) | (g.height(box) < 8)).select("doc_id", "name")


def layout_report(detected: DataFrame, fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """A row a document: how well mapped boxes sit on the detected ones, less penalties for overlaps and tiny boxes."""
    first = detected.groupBy("doc_id", F.col("label").alias("source_key")).agg(F.min_by("box", "ord").alias("d"))
    joined = mappings.where("status = 'mapped' and target_field <> ''").join(first, ["doc_id", "source_key"]).join(fields.where("box is not null").select("doc_id", F.col("name").alias("target_field"), F.col("box").alias("f")), ["doc_id", "target_field"])
    d, f = F.col("d"), F.col("f")
    ratio = lambda a, b: F.least(a, b) / F.greatest(a, b, F.lit(1.0))
    iou = g.iou(d, f)
    score = F.least(F.greatest(iou * 0.52 + (1 - g.center_distance(d, f)) * 0.26 + ratio(g.width(d), g.width(f)) * 0.14 + ratio(g.height(d), g.height(f)) * 0.08, F.lit(0.0)), F.lit(1.0))
    drift = F.abs((d["top"] + d["bottom"] - f["top"] - f["bottom"]) / 2) / F.greatest(g.height(d), F.lit(1.0))
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("target_field")))), ",")
    aligned = joined.groupBy("doc_id").agg(
        F.avg(iou).alias("mean_iou"), F.avg(score).alias("alignment"),
        names(score < 0.68).alias("low_alignment"), names(drift > 0.45).alias("row_misaligned"),
        names(f["left"] < d["left"] - 4).alias("early_start"), names((f["right"] > d["right"] + 4) | (f["bottom"] > d["bottom"] + 4)).alias("overflowing"),
    )
    overlaps = overlapping_pairs(fields).groupBy("doc_id").agg(F.count("*").alias("overlaps"))
    tiny = tiny_fields(fields).groupBy("doc_id").agg(F.count_distinct("name").alias("tiny"))
    all_ = fields.select("doc_id").distinct().join(aligned, "doc_id", "left").join(overlaps, "doc_id", "left").join(tiny, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    penalty = F.least(F.lit(1.0), zero("overlaps") * 0.18) + F.least(F.lit(1.0), zero("tiny") * 0.12)
    return all_.select("doc_id", F.bround(zero("mean_iou"), 4).alias("mean_iou"), F.bround(F.greatest(F.lit(0.0), zero("alignment") - penalty), 4).alias("geometry_score"), zero("overlaps").alias("overlap_pairs"), zero("tiny").alias("tiny"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("low_alignment", "row_misaligned", "early_start", "overflowing")])


def nearest_previous(lines: DataFrame, partition: list[str], order: list[str], is_context, at: str, most: float) -> DataFrame:
    """Each line with the ``text`` of the last context line before it, if that is within ``most`` of it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_context, F.struct(F.col(at).alias("at"), F.col("text").alias("text"))), ignorenulls=True).over(w)
    return lines.withColumn("_c", last).withColumn("context", F.when(F.col(at) - F.col("_c.at") <= most, F.col("_c.text"))).drop("_c")


def candidates_on_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Interval join of text lines with the rules drawn near them on the page; both are dealt into bands of 32 units."""
    wide = lines.withColumn("band", F.explode(F.sequence(F.floor((F.col("top") - 2) / 32), F.floor((F.col("bottom") + 0.5) / 32))))
    near = rules.select("doc_id", "page_number", F.col("rule_id"), *[F.col(c).alias(f"r_{c}") for c in ("left", "top", "right", "bottom")]).withColumn("band", F.explode(F.sequence(F.floor(F.col("r_top") / 32), F.floor(F.col("r_bottom") / 32))))
    hit = (F.col("r_bottom") >= F.col("top") - 2) & (F.col("r_top") <= F.col("bottom") + 0.5) & (F.col("r_right") >= F.col("left") - 6) & (F.col("r_left") <= F.col("right") + 160)
    first = F.greatest(F.floor((F.col("top") - 2) / 32), F.floor(F.col("r_top") / 32))
    return wide.join(near, ["doc_id", "page_number", "band"]).where(hit & (F.col("band") == first)).drop("band")


def nearest_right(pairs: DataFrame) -> DataFrame:
    """Of ``candidates_on_lines``, the rule closest to each line's end, those to its right first."""
    gap = F.col("r_left") - F.col("right")
    return pairs.groupBy("doc_id", "page_number", "line_id").agg(F.min_by("rule_id", F.struct((gap < 0).cast("int"), F.abs(gap), F.col("rule_id"))).alias("rule_id"))


#: A box is tiny below this width or height; a missing one, a lone tiny one, and each tiny one cost so much of the geometry score.
TINY_WIDTH, TINY_HEIGHT = 18.0, 8.0
LONE_TINY, EACH_TINY, MOST_TINY = 0.72, 0.08, 0.35


def _is_tiny(box):
    return (g.width(box) < TINY_WIDTH) | (g.height(box) < TINY_HEIGHT)


def layout_codes(fields: DataFrame, least: float = 0.04) -> DataFrame:
    """doc_id, code: missing_box, tiny and overlap warnings of active fields (doc_id, ord, name, box)."""
    missing = fields.where("box is null").select("doc_id", F.concat(F.lit("missing_box:"), "name").alias("code"))
    tiny = fields.where(F.col("box").isNotNull() & _is_tiny(F.col("box"))).select("doc_id", F.concat(F.lit("tiny:"), "name").alias("code"))
    overlap = overlapping_pairs(fields, least).select("doc_id", F.concat(F.lit("overlap:"), "a", F.lit(":"), "b").alias("code"))
    return missing.unionByName(tiny).unionByName(overlap)


def geometry_score(fields: DataFrame) -> DataFrame:
    """doc_id, geometry_score: 1 less the mean of each field's worst overlap with a later field, less what its tiny fields cost.

    A field without a box counts as overlapped wholly. A lone field is judged by its size only. fields: doc_id, ord, name, box.
    """
    worst = overlapping_pairs(fields, 0.0).groupBy("doc_id", F.col("a").alias("name")).agg(F.max("iou").alias("iou"))
    rows = fields.join(worst, ["doc_id", "name"], "left")
    tiny = F.col("box").isNotNull() & _is_tiny(F.col("box"))
    by = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("box").isNull(), 1.0).otherwise(F.coalesce("iou", F.lit(0.0)))).alias("mean"), F.count_if(tiny).alias("tiny"), F.count_if(F.col("box").isNull()).alias("none"))
    lone = F.when(F.col("none") > 0, 0.0).when(F.col("tiny") > 0, LONE_TINY).otherwise(1.0)
    many = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 1 - F.col("mean")) - F.least(F.lit(MOST_TINY), F.col("tiny") * EACH_TINY))
    return by.select("doc_id", F.when(F.col("n") == 1, lone).otherwise(many).alias("geometry_score"))


def reading_order(fields: DataFrame) -> DataFrame:
    """``fields`` (doc_id, name, box, ...) with place: by page, top, left and name, those without a box last."""
    order = [F.col(f"box.{c}").asc_nulls_last() for c in ("page_number", "top", "left")]
    return fields.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "name")))


def continuation_boxes(boxes: DataFrame) -> DataFrame:
    """doc_id, name, k, box: the lines of each continuation box, equal bands less two units above and below; a box of one line stays as it is."""
    height = g.height(F.col("box"))
    lines = F.when(height <= 24, 1).when(height <= 44, 2).otherwise(F.greatest(F.lit(2), F.floor((height + 2) / 20))).cast("int")
    rows = boxes.where("box is not null").withColumn("n", lines).withColumn("k", F.explode(F.sequence(F.lit(0), lines - 1)))
    edge = lambda k: F.col("box.top") + height / F.col("n") * k
    band = F.struct(F.col("box.page_number").alias("page_number"), F.col("box.left").alias("left"), (edge(F.col("k")) + 2).alias("top"), F.col("box.right").alias("right"), (edge(F.col("k") + 1) - 2).alias("bottom"))
    whole = F.struct(*[F.col(f"box.{c}").alias(c) for c in ("page_number", "left", "top", "right", "bottom")])
    return rows.select("doc_id", "name", "k", F.when(F.col("n") == 1, whole).otherwise(band).alias("box"))
