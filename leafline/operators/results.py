"""What an extraction comes to: values from evidence, the result of a document, its summaries and shapes for callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, text
from ..sources.tables import spread
from . import repair, review

#: The least confidence of a mapping, that of a transcript without any, and the warnings that feedback quotes.
LEAST_MAPPING, PLAIN_TRANSCRIPT, QUOTED = 0.60, 0.7, 5


def values_of_evidence(evidence: DataFrame) -> DataFrame:
    """doc_id, ord, source_key, value, confidence, raw_text, source_kind of the evidence of each field; the last of a key counts, at the place of the first.

    evidence: doc_id, ord, field_key, resolved_value, breakdown (map<string,double>), candidates (array<struct<value,raw_text>>), reason. The confidence is the
    breakdown's for the selected value, else the field's, else the overall one; one that is there but null is 0. Blank keys are left out.
    """
    part = F.col("breakdown")
    trust = F.lit(0.0)
    for name in ("overall", "field_confidence", "selected"):
        trust = F.when(F.map_contains_key(part, name), F.coalesce(F.try_element_at(part, F.lit(name)), F.lit(0.0))).otherwise(trust)
    value, first = F.coalesce("resolved_value", F.lit("")), F.get("candidates", F.lit(0))
    given = lambda c: F.nullif(c, F.lit(""))
    rows = evidence.withColumn("source_key", text.strip(F.col("field_key"))).where("source_key <> ''")
    one = F.struct(value.alias("value"), F.coalesce(trust, F.lit(0.0)).alias("confidence"), F.coalesce(given(first["raw_text"]), given(first["value"]), value).alias("raw_text"), F.coalesce(given(F.col("reason")), F.lit("resolver_evidence")).alias("source_kind"))
    kept = rows.groupBy("doc_id", "source_key").agg(F.min("ord").alias("ord"), F.max_by(one, "ord").alias("v"))
    return kept.select("doc_id", "ord", "source_key", "v.*")


def resolved_or_read(resolved: DataFrame, read: DataFrame) -> DataFrame:
    """The values of evidence of each document that has any, and the values that were read of the others. Both have the same columns."""
    return resolved.unionByName(read.join(resolved.select("doc_id").distinct(), "doc_id", "left_anti"))


def normalized_values(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``values`` after the rules of repair, and doc_id, confidence: the mean over a document's values then. values: as ``repair`` takes them."""
    fixed = repair.repair(values)
    return fixed, fixed.groupBy("doc_id").agg(confidence.mean(F.col("confidence")).alias("confidence"))


def extraction_results(values: DataFrame, mappings: DataFrame, least: float = LEAST_MAPPING) -> DataFrame:
    """doc_id, n_values, n_mappings, weak_mappings, issue, review_items, confidence: a row a document.

    Weak mappings are below ``least`` and their value isn't expected to be empty; they make an issue. The confidence is the mean over values and mappings together.
    values: doc_id, source_key, value, confidence, review_reasons; mappings: doc_id, source_key, target_field, confidence, status.
    """
    key = ["doc_id", "source_key"]
    blank = spread(values.where(F.array_contains("review_reasons", "expected_empty")).select(*key), *key).distinct().withColumn("blank", F.lit(True))
    weak = (F.col("confidence") < least) & F.col("blank").isNull()
    own = spread(mappings.select(*key, "confidence"), *key).join(blank, key, "left").select("doc_id", F.lit(0).alias("v"), F.lit(1).alias("m"), weak.cast("int").alias("w"), "confidence", F.lit(0).alias("r"))
    val = values.select("doc_id", F.lit(1).alias("v"), F.lit(0).alias("m"), F.lit(0).alias("w"), "confidence", F.lit(0).alias("r"))
    items = review.review_items(values, mappings).select("doc_id", F.lit(0).alias("v"), F.lit(0).alias("m"), F.lit(0).alias("w"), F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("r"))
    by = own.unionByName(val).unionByName(items).groupBy("doc_id")
    out = by.agg(F.sum("v").alias("n_values"), F.sum("m").alias("n_mappings"), F.sum("w").alias("weak_mappings"), F.sum("r").alias("review_items"), F.coalesce(F.avg(F.when(F.col("r") == 0, confidence.clamp(F.col("confidence")))), F.lit(0.0)).alias("confidence"))
    return out.withColumn("issue", F.when(F.col("weak_mappings") > 0, "data.mapping.review_required"))


def extraction_payload(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, fields: the values of a document in the order of their keys, each with the target that its last mapping names, as JSON.

    values: doc_id, source_key, value, confidence, raw_text, source_kind, review_reasons; mappings: doc_id, ord, source_key, target_field.
    """
    last = mappings.groupBy("doc_id", "source_key").agg(F.max_by("target_field", "ord").alias("mapped_target"))
    rows = values.join(last, ["doc_id", "source_key"], "left")
    one = F.struct(F.col("source_key").alias("key"), "value", "confidence", "raw_text", "source_kind", "review_reasons", F.coalesce("mapped_target", F.lit("")).alias("mapped_target"))
    return rows.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("fields"))


def transcript_summary(pages: DataFrame, lines: DataFrame, cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, pages, filled_pages, lines, cells, boxes: counts of what a transcript holds. pages: doc_id, page_number, text; the others: doc_id."""
    one = lambda df, **own: df.select("doc_id", *[F.lit(own.get(c, 0)).alias(c) if not isinstance(own.get(c), Column) else own[c].alias(c) for c in ("pages", "filled_pages", "lines", "cells", "boxes")])
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S").cast("int")
    every = one(pages, pages=1, filled_pages=filled).unionByName(one(lines, lines=1)).unionByName(one(cells, cells=1)).unionByName(one(boxes, boxes=1))
    return every.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("pages", "filled_pages", "lines", "cells", "boxes")])


def transcript_confidence(confidences: Column, page_texts: Column) -> Column:
    """The greatest of a provider's confidences (map), that of a plain transcript if there are only texts (map), else 0."""
    most = F.array_max(F.map_values(confidences))
    return F.when(F.size(confidences) > 0, F.coalesce(most, F.lit(0.0))).when(F.size(page_texts) > 0, PLAIN_TRANSCRIPT).otherwise(0.0)


def user_feedback(rows: DataFrame) -> DataFrame:
    """``rows`` (route, confidence, verification) with summary, review_required and highlights, which quote the first warnings.

    verification: struct passed, review_required, overall_score, warnings; null if nothing was verified.
    """
    v = F.col("verification")
    base = F.format_string("route=%s confidence=%.3f", "route", "confidence")
    told = F.format_string("%s verify_score=%.3f review=%s", base, v["overall_score"], F.when(v["review_required"], "required").otherwise("not_required"))
    verdict = F.array(F.when(v["passed"], "verification_passed").otherwise("verification_failed"))
    notes = F.concat(verdict, F.slice(F.coalesce(v["warnings"], F.array().cast("array<string>")), 1, QUOTED))
    return rows.select("*", F.when(v.isNull(), base).otherwise(told).alias("summary"), F.coalesce(v["review_required"], F.lit(False)).alias("review_required"), F.when(v.isNull(), F.array().cast("array<string>")).otherwise(notes).alias("highlights"))
