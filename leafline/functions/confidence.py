"""Confidence arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prior confidence by source, and the penalty of each review reason.
PRIORS = {
    "pdf_direct": 0.99,
    "api_input": 0.90,
    "checkbox_pixel": 0.90,
    "checkbox_blue_search": 0.84,
    "llm_crop_checkbox": 0.76,
    "llm_page": 0.82,
    "llm_retry_contact": 0.74,
    "llm_retry_choice": 0.72,
    "llm_retry_date": 0.70,
    "llm_retry_code": 0.70,
    "llm_retry_empty": 0.66,
    "llm_crop": 0.70,
    "llm_crop_ocr_hint": 0.62,
    "rule_family": 0.84,
    "rule_compound": 0.84,
}
PENALTIES = {
    "missing_value": 1.00,
    "expected_empty": 0.00,
    "borrowed_neighbor_risk": 0.18,
    "ocr_confusion_risk": 0.08,
    "low_mapping_confidence": 0.20,
    "ambiguous_date_family": 0.12,
    "field_family_conflict": 0.18,
}
OTHER_PRIOR = 0.78
#: Lower edges of the calibration buckets; the last one takes 1.0 in.
BUCKETS = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def _lookup(table: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(other))


def derived(source_kind: Column, value: Column, reasons: Column) -> Column:
    """The prior of the source less the penalties of its reasons; 0 for a blank value."""
    kind = F.coalesce(F.nullif(source_kind, F.lit("")), F.lit("llm_page"))
    penalty = F.aggregate(F.coalesce(reasons, F.array().cast("array<string>")), F.lit(0.0), lambda s, r: s + _lookup(PENALTIES, r, 0.0))
    return F.when(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "") == "", 0.0).otherwise(clamp(_lookup(PRIORS, kind, OTHER_PRIOR) - penalty))


def mean(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.avg(clamp(value)), F.lit(default))


def mean_positive(value: Column) -> Column:
    """Mean of the stages that have a score."""
    return F.coalesce(F.avg(F.when(value > 0, value)), F.lit(0.0))


def bucket(value: Column) -> Column:
    out = F.lit(BUCKETS[0])
    for low, label in zip((0.2, 0.4, 0.6), BUCKETS[1:4], strict=True):
        out = F.when((value >= low) & (value < round(low + 0.2, 1)), label).otherwise(out)
    return F.when((value >= 0.8) & (value < 1.01), BUCKETS[4]).otherwise(out)


def blended(analysed: Column, classified: Column) -> Column:
    """Two confidences, percentages rescaled: the mean, or the one above 0."""
    unit = lambda c: F.when(c > 1, c / 100).otherwise(c)
    a, b = unit(analysed), unit(classified)
    return clamp(F.when(a <= 0, b).when(b <= 0, a).otherwise((a + b) / 2))
