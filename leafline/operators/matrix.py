"""The validation matrix: subsets of all datasets at the limits of a pack, their metrics and gates in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import review

#: The most samples of a dataset in each pack.
PACK_LIMITS = {
    "funsd_plus": {"smoke": 10, "regression": 50, "tuning": 100, "release": 50},
    "fir": {"smoke": 5, "regression": 30, "tuning": 100, "release": 30},
    "template_e2e": {"smoke": 3, "regression": 10, "tuning": 10, "release": 10},
    "turkish_printed": {"smoke": 3, "regression": 10, "tuning": 25, "release": 10},
    "turkish_handwritten": {"smoke": 3, "regression": 10, "tuning": 25, "release": 10},
    "turkish_petitions": {"smoke": 3, "regression": 10, "tuning": 25, "release": 10},
}
#: Fixed value: the gate that stands for a look at a real document.
MANUAL_GATE = ("real_demo", "manual_visual_pass")


def pack_limits(spark, pack: str, requested: int | None = None) -> DataFrame:
    """dataset, most: the least of what is requested and what the pack allows; null where neither says anything."""
    rows = [(name, min((x for x in (requested, None if pack == "custom" else packs.get(pack)) if x is not None), default=None)) for name, packs in PACK_LIMITS.items()]
    return spark.createDataFrame(rows, "dataset string, most int")


def pack_subset(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """``samples`` (dataset, bucket, sample_id, ...) within their dataset's limit: one of each bucket in turn, buckets in order, each by id.

    A limit that is null, 0 or less takes all, as does a dataset without one. No row beyond the limit of its own bucket can be taken, so those
    go before the rows of a dataset come together.
    """
    turn = Window.partitionBy("dataset", "bucket").orderBy("sample_id")
    rows = samples.join(F.broadcast(limits), "dataset", "left").withColumn("_most", F.when(F.col("most") > 0, F.col("most"))).drop("most")
    rows = rows.withColumn("_turn", F.row_number().over(turn))
    whole = rows.where("_most is null")
    rows = rows.where(F.col("_turn") <= F.col("_most"))
    place = Window.partitionBy("dataset").orderBy("_turn", "bucket", "sample_id")
    taken = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= F.col("_most"))
    return taken.select(*samples.columns).unionByName(whole.select(*samples.columns))


def metrics(samples: DataFrame) -> DataFrame:
    """dataset and a column a metric, from samples (dataset, fields, exact, covered, matched, success, confidence, review).

    Rates of fields are over all fields of a dataset, those of cases over its samples.
    """
    rate = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("fields")), F.lit(0.0))
    share = lambda c: F.avg(F.col(c).cast("int"))
    return samples.groupBy("dataset").agg(
        rate("exact").alias("field_normalized_exact_match"), rate("covered").alias("field_coverage"), rate("matched").alias("field_match_rate"),
        share("success").alias("case_success_rate"), F.avg("confidence").alias("confidence_average"), share("review").alias("review_required_rate"),
    )


def validation_matrix(samples: DataFrame, manual_pass: bool) -> DataFrame:
    """dataset, metric, actual, least, passed: the gates of every dataset, then whether all of its gates pass (metric null), and whether all do (both null).

    The verdicts are a rollup over the gates, the manual one included.
    """
    gate = review.gates(metrics(samples)).select("dataset", "metric", F.col("actual").cast("double").alias("actual"), "least", "passed")
    manual = samples.sparkSession.createDataFrame([(*MANUAL_GATE, float(manual_pass), 1.0, manual_pass)], "dataset string, metric string, actual double, least double, passed boolean")
    gate = gate.unionByName(manual)
    none = F.lit(None).cast("double")
    verdict = gate.rollup("dataset").agg(F.bool_and("passed").alias("passed")).select("dataset", F.lit(None).cast("string").alias("metric"), none.alias("actual"), none.alias("least"), "passed")
    return gate.unionByName(verdict)
