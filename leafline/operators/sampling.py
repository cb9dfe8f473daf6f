"""Splits, stratified subsets and top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_tenth(name: Column) -> Column:
    """md5 of the name as a whole number, modulo 10, from its two 64-bit halves."""
    digest = F.md5(name)
    last = lambda part: F.right(F.conv(part, 16, 10), F.lit(1)).cast("int")
    return (last(F.left(digest, F.lit(16))) * 6 + last(F.right(digest, F.lit(16)))) % 10


def split_of(name: Column) -> Column:
    tenth = hash_tenth(name)
    return F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train")


def release_bucket(fields: Column, multiline: Column, pages: Column, page_width: Column, page_height: Column) -> Column:
    """A stratum from the number of fields, multi-line fields, pages and the shape of the page."""
    density = F.when(fields <= 4, "sparse").when(fields <= 8, "medium").otherwise("dense")
    aspect = F.when(page_width > page_height * 1.1, "landscape").when(page_height > page_width * 1.1, "portrait").otherwise("squareish")
    return F.struct(density.alias("density"), F.when(multiline, "multiline").otherwise("single").alias("lines"), F.when(pages > 1, "multi_page").otherwise("single_page").alias("pages"), aspect.alias("aspect"))


def stratified_subset(samples: DataFrame, bucket: str, id_col: str, limit: int) -> DataFrame:
    """``limit`` rows, one of each bucket in turn (buckets in order, each by id); all rows if there are no more.

    No row beyond the limit of its own bucket can be taken, and Spark drops those before the shuffle.
    """
    turn = Window.partitionBy(bucket).orderBy(id_col)
    ranked = samples.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", bucket, id_col).limit(limit).drop("turn")


def worst_k(samples: DataFrame, k: int = 10) -> DataFrame:
    return samples.orderBy("match_rate", "confidence", "sample_id").limit(k)


def showcase(samples: DataFrame) -> DataFrame:
    """slot, sample_id: the best, the worst and, of the others, the one closest to one half."""
    good = samples.orderBy(F.desc("match_rate"), F.desc("coverage"), F.desc("confidence"), "sample_id").limit(1).select(F.lit("good").alias("slot"), "sample_id")
    hard = samples.orderBy("match_rate", "coverage", "confidence", "sample_id").limit(1).select(F.lit("hard").alias("slot"), "sample_id")
    used = good.unionByName(hard)
    middle = samples.join(F.broadcast(used.select("sample_id")), "sample_id", "left_anti").orderBy(F.abs(F.col("match_rate") - 0.5), "confidence", "sample_id").limit(1).select(F.lit("borderline").alias("slot"), "sample_id")
    worst = samples.orderBy("match_rate", "coverage", "confidence", F.desc("sample_id")).limit(1).select(F.lit("borderline").alias("slot"), "sample_id")
    last = middle.withColumn("o", F.lit(0)).unionByName(worst.withColumn("o", F.lit(1))).orderBy("o").limit(1).drop("o")
    return used.unionByName(last)
