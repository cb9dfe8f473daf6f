"""Review items, the manual queue and release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import spread

#: Least rates for a release, by dataset and metric.
GATES = [
    ("funsd_plus", "field_normalized_exact_match", 0.90),
    ("funsd_plus", "field_coverage", 0.98),
    ("fir", "field_normalized_exact_match", 0.72),
    ("fir", "field_coverage", 0.88),
    ("template_e2e", "field_match_rate", 0.97),
    ("template_e2e", "case_success_rate", 0.80),
]


def review_items(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, key, reason: reasons of values, blank values without one, and mappings that aren't settled; each once."""
    reasons = values.select("doc_id", F.col("source_key").alias("key"), F.explode("review_reasons").alias("reason")).where("reason <> 'expected_empty'")
    empty = ~F.array_contains("review_reasons", "expected_empty") & ~F.col("value").rlike(r"(?U)\S")
    blank = values.where(empty).select("doc_id", F.col("source_key").alias("key"), F.lit("missing_value").alias("reason"))
    weak = mappings.where("status <> 'mapped'").select("doc_id", F.col("source_key").alias("key"), F.lit("low_mapping_confidence").alias("reason"))
    return spread(reasons.unionByName(blank).unionByName(weak), "doc_id", "key", "reason").distinct()


def manual_queue(scores: DataFrame, items: DataFrame) -> DataFrame:
    """dataset, sample_id, field, reason, expected, predicted of every field that doesn't match; the last review reason of the field, or its status."""
    last = items.where("reason <> 'expected_empty'").groupBy("sample_id", "key").agg(F.max_by("reason", "ord").alias("reason"))
    queue = scores.where(~F.col("matched")).join(last, ["sample_id", "key"], "left")
    return queue.select("dataset", "sample_id", F.col("key").alias("field"), F.coalesce("reason", "status").alias("reason"), F.col("expected_value").alias("expected"), F.col("predicted_value").alias("predicted"))


def sorted_queue(queue: DataFrame) -> DataFrame:
    """A queue by dataset, sample, field and reason, sorted over range partitions."""
    return queue.orderBy("dataset", "sample_id", "field", "reason")


def gates(metrics: DataFrame) -> DataFrame:
    """dataset, metric, actual, least, passed from metrics (dataset, then a column for each metric)."""
    spark = metrics.sparkSession
    names = [c for c in metrics.columns if c != "dataset"]
    long = metrics.unpivot("dataset", names, "metric", "actual")
    return long.join(spark.createDataFrame(GATES, "dataset string, metric string, least double"), ["dataset", "metric"]).withColumn("passed", F.col("actual") >= F.col("least"))


def released(datasets: DataFrame, checked: DataFrame) -> DataFrame:
    """dataset, passed: all of its gates; true for one without gates."""
    own = checked.groupBy("dataset").agg(F.bool_and("passed").alias("passed"))
    return datasets.join(own, "dataset", "left").select("dataset", F.coalesce("passed", F.lit(True)).alias("passed"))


def region_targets(fields: DataFrame, values: DataFrame, densities: DataFrame, critical: list[str]) -> DataFrame:
    """doc_id, field_key, page_number, kind, value, confidence, density, critical of each field with a box, for ``region_plan``.

    A field's value is that under the logical name of its label (its own without one), else that under its name; its density that of its page.
    It is critical if ``critical`` has either logical name or its name. fields: doc_id, name, label, kind, box; values: doc_id, source_key, value, confidence; densities: doc_id, page_number, density.
    """
    label = F.coalesce(F.nullif("label", F.lit("")), "name")
    rows = fields.where("box is not null").select("doc_id", "name", "kind", text.logical_name(label).alias("field_key"), F.col("box.page_number").alias("page_number"))
    seen = lambda key, c: values.select("doc_id", F.col("source_key").alias(key), F.struct("value", "confidence").alias(c))
    rows = rows.join(seen("field_key", "_by_label"), ["doc_id", "field_key"], "left").join(seen("name", "_by_name"), ["doc_id", "name"], "left")
    rows = rows.join(densities.select("doc_id", "page_number", "density"), ["doc_id", "page_number"], "left")
    own = F.coalesce("_by_label", "_by_name")
    urgent = F.col("field_key").isin(critical) | text.logical_name(F.col("name")).isin(critical) | F.col("name").isin(critical) if critical else F.lit(False)
    return rows.select("doc_id", "field_key", "page_number", "kind", own["value"].alias("value"), F.coalesce(own["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce("density", F.lit(0.0)).alias("density"), urgent.alias("critical"))


def region_plan(targets: DataFrame, critical: list[str], limit: int = 24) -> DataFrame:
    """Which fields to read again, the ``limit`` most urgent of each document.

    targets: doc_id, field_key, page_number, kind, value, confidence, density, and critical if ``region_targets`` made them.
    """
    blank = ~F.coalesce(F.col("value"), F.lit("")).rlike(r"(?U)\S")
    weak, kind = F.col("confidence") < 0.62, F.col("kind").isin("date", "multiline")
    key = F.col("critical") if "critical" in targets.columns else F.col("field_key").isin(critical) if critical else F.lit(False)
    base = F.when(blank, 3).when(weak, 2).when(kind, 1).otherwise(0)
    dense = F.coalesce("density", F.lit(0.0)) >= 0.55
    priority = F.when(key, F.greatest(base, F.lit(3))).otherwise(base) + dense.cast("int")
    reason = F.when(blank, "missing_value").when(weak, "low_confidence").when(kind | key, "critical_field").when(dense, "dense_layout")
    w = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "page_number", "field_key")
    return targets.select("doc_id", "field_key", "page_number", reason.alias("reason"), priority.alias("priority")).where("reason is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
