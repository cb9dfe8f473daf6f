"""Expected against predicted field values: per field, per sample and over all.

Tables: expected (sample_id, ord, key, value, kind), predicted (sample_id, ord, key, value, confidence).
Everything is keyed by sample_id first, so one hash partitioning serves all joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, similarity, text


def score_fields(expected: DataFrame, predicted: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Each expected field with the prediction of its key or, failing that, of its normalised key; of repeated keys the last counts.

    Checkboxes match by state, other fields by canonical form. With ``fuzzy``, names match by similarity too and statutes are repaired
    first, which takes Arrow batches; without it the plan holds column expressions only.
    """
    p = predicted.withColumn("key", text.logical_name(F.col("key")))
    last = lambda by: p.groupBy("sample_id", by.alias("k")).agg(F.max_by(F.struct("value", "confidence"), "ord").alias("p"))
    exact, loose = last(F.col("key")), last(text.normalize_text(F.col("key")))
    e = expected.withColumn("nk", text.normalize_text(F.col("key")))
    joined = (
        e.join(exact.select(F.col("sample_id").alias("s1"), F.col("k").alias("k1"), F.col("p").alias("p1")), (F.col("sample_id") == F.col("s1")) & (F.col("key") == F.col("k1")), "left")
        .join(loose.select(F.col("sample_id").alias("s2"), F.col("k").alias("k2"), F.col("p").alias("p2")), (F.col("sample_id") == F.col("s2")) & (F.col("nk") == F.col("k2")), "left")
        .withColumn("p", F.coalesce("p1", "p2"))
    )
    value = F.coalesce(F.col("p.value"), F.lit(""))
    scored = joined.select("sample_id", "ord", "key", F.col("value").alias("expected_value"), "kind", value.alias("predicted_value"), F.coalesce(F.col("p.confidence"), F.lit(0.0)).alias("confidence"))
    scored = scored.withColumns({"_pe": text.normalize_text(F.col("expected_value")), "_pp": text.normalize_text(F.col("predicted_value")), "_pk": text.normalize_text(F.col("key"))})
    forms = {"_ce": ("expected_value", "_pe"), "_cp": ("predicted_value", "_pp")}
    scored = scored.withColumns({c: text.canonical_value(F.col(v), F.col(p), F.col("_pk")) for c, (v, p) in forms.items()})
    same = F.col("_ce") == F.col("_cp")
    if fuzzy:
        codes = lambda v: F.trim(F.regexp_replace(text.normalize_text(similarity.repair_statutes(F.col(v))), r"\bipc\b", ""))
        same = F.when(F.col("_pk") == "statutes", codes("expected_value") == codes("predicted_value")).otherwise(same) | (F.col("_pk").contains("name") & similarity.names_match(F.col("_ce"), F.col("_cp")))
    matched = F.when(F.col("kind") == "checkbox", text.checkbox_state(F.col("_pe")) == text.checkbox_state(F.col("_pp"))).otherwise(same)
    scored = scored.withColumn("matched", matched).drop("_pe", "_pp", "_pk", "_ce", "_cp").withColumn("covered", F.col("predicted_value").rlike(r"(?U)\S"))
    return scored.withColumn("status", F.when(F.col("matched"), "matched").when(~F.col("covered"), "missing").otherwise("mismatch"))


def unexpected_fields(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """sample_id, key of predictions that no expected key meets, by name or by normalised name."""
    p = predicted.select("sample_id", text.logical_name(F.col("key")).alias("key")).distinct().withColumn("nk", text.normalize_text(F.col("key")))
    names = expected.select("sample_id", "key", text.normalize_text(F.col("key")).alias("nk"))
    return p.join(names, ["sample_id", "key"], "left_anti").join(names.select("sample_id", "nk"), ["sample_id", "nk"], "left_anti").select("sample_id", "key")


def sample_metrics(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """samples (sample_id, confidence, review_required) with match and coverage rates; a sample without fields is a success."""
    per = scores.groupBy("sample_id").agg(F.count("*").alias("fields"), F.count_if("matched").alias("matches"), F.count_if("covered").alias("covered"))
    n = F.greatest(F.coalesce("fields", F.lit(0)), F.lit(1))
    return samples.join(per, "sample_id", "left").select(
        "sample_id", "confidence", "review_required", F.coalesce("fields", F.lit(0)).alias("fields"),
        (F.coalesce("matches", F.lit(0)) / n).alias("match_rate"), (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        (F.coalesce("matches", F.lit(0)) == F.coalesce("fields", F.lit(0))).alias("success"),
    )


def aggregate_metrics(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: field rates over all fields, document rates over all samples."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    fields = scores.agg(rate("matched").alias("field_match"), rate("covered").alias("field_coverage"))
    docs = samples.agg(rate("success").alias("document_success"), confidence.mean(F.col("confidence")).alias("mean_confidence"), rate("review_required").alias("review_rate"))
    return fields.crossJoin(docs)  # one row each


def calibration(scores: DataFrame) -> DataFrame:
    """bucket, fields, match_rate of all five confidence buckets, empty ones included."""
    labels = scores.sparkSession.createDataFrame([(b,) for b in confidence.BUCKETS], "bucket string")
    own = scores.groupBy(confidence.bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("fields"), F.avg(F.col("matched").cast("double")).alias("match_rate"))
    return labels.join(own, "bucket", "left").select("bucket", F.coalesce("fields", F.lit(0)).alias("fields"), F.coalesce("match_rate", F.lit(0.0)).alias("match_rate"))


def issues(scores: DataFrame, unexpected: DataFrame) -> DataFrame:
    """sample_id, code, key of missing and unexpected fields."""
    missing = scores.where("status = 'missing'").select("sample_id", F.lit("benchmark.missing_field").alias("code"), "key")
    return missing.unionByName(unexpected.select("sample_id", F.lit("benchmark.unexpected_field").alias("code"), "key"))


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n"))
