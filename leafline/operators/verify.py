"""Verification of a finished document against its source: a score a field, then a verdict a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text


def field_results(fields: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """fields (doc_id, name, page_number, expected, numeric) with how well the texts read on the source and the output page agree with what is expected.

    sources and outputs: doc_id, page_number, name, observed.
    """
    key = ["doc_id", "page_number", "name"]
    joined = fields.join(sources.withColumnRenamed("observed", "seen"), key, "left").join(outputs.withColumnRenamed("observed", "shown"), key, "left")
    score = lambda c: similarity.match_score(F.col("expected"), F.coalesce(c, F.lit("")), F.col("numeric"))
    return joined.select(*key, score("seen").alias("source_score"), score("shown").alias("output_score"))


def verdicts(results: DataFrame, geometry: DataFrame, critical: list[str], source_least: float = 0.72, output_least: float = 0.72) -> DataFrame:
    """doc_id, source, output, overall, weak, critical_failures, passed.

    geometry: doc_id, geometry_score. The overall score is the mean of geometry and evidence (the mean of source and output) times 0.92, as no
    model reviews the pages. A document passes with a geometry of 0.82, both means at their thresholds, at most a quarter (one at least) of its fields weak, and no critical field under nine tenths of a threshold.
    """
    weak = (F.col("source_score") < source_least) | (F.col("output_score") < output_least)
    failing = (F.col("source_score") < source_least * 0.9) | (F.col("output_score") < output_least * 0.9)
    mine = F.col("name").isin(critical) if critical else F.lit(False)
    by = results.groupBy("doc_id").agg(
        F.avg("source_score").alias("source"), F.avg("output_score").alias("output"), F.count("*").alias("n"), F.count_if(weak).alias("weak"),
        F.array_join(F.array_sort(F.collect_set(F.when(mine & failing, F.col("name")))), ",").alias("critical_failures"),
    )
    out = by.join(geometry, "doc_id", "left").withColumn("overall", ((F.col("source") + F.col("output")) / 2 + F.coalesce("geometry_score", F.lit(0.0))) / 2 * 0.92)
    passed = (F.coalesce("geometry_score", F.lit(0.0)) >= 0.82) & (F.col("source") >= source_least) & (F.col("output") >= output_least) & (F.col("weak") <= F.greatest(F.lit(1), F.expr("n div 4"))) & (F.col("critical_failures") == "")
    return out.select("doc_id", "source", "output", "overall", "weak", "critical_failures", passed.alias("passed"))


def borrowed_values(values: DataFrame) -> DataFrame:
    """doc_id, source_key of values that another field of the document holds too."""
    plain = values.select("doc_id", "source_key", text.normalize_text(F.col("value")).alias("plain")).where("plain <> ''")
    twice = plain.groupBy("doc_id", "plain").agg(F.count_distinct("source_key").alias("n")).where("n > 1")
    return plain.join(twice, ["doc_id", "plain"], "left_semi").select("doc_id", "source_key")


def plain_overlap(left: Column, right: Column, most: int = 8, least: int = 3) -> Column:
    """``overlap_words`` of normalised texts."""
    a, b = F.split(left, " "), F.split(right, " ")
    runs = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda k: (F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, F.size(a) - F.least(k, F.size(a)) + 1, k) == F.slice(b, 1, k)))
    return F.coalesce(F.get(runs, F.lit(0)), F.lit(0))


def overlap_words(left: Column, right: Column, most: int = 8, least: int = 3) -> Column:
    """Words at the end of ``left`` that ``right`` starts with: the longest run of ``most`` down to ``least``; 0 without one."""
    return plain_overlap(text.normalize_text(left), text.normalize_text(right), most, least)


def marked_choice(value: Column) -> Column:
    """The token before the first check mark of a list of choices, or after it if none is before; the value itself without a mark."""
    tokens = F.filter(F.split(value, r"\s+"), lambda t: t != "")
    at = F.get(F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^[\[(]?[xX✓✔☑☒][\])]?$"), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(at.isNull(), value).otherwise(F.coalesce(F.when(at > 0, F.get(tokens, at - 1)), F.get(tokens, at + 1), value))
