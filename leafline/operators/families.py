"""One answer out of several: checkbox families, alias groups, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_families(options: DataFrame) -> DataFrame:
    """The winner of each family, and what becomes of its options.

    options: doc_id, family, ord, key, selected, confidence. The selected option with the highest
    confidence wins (ties: the first); the others are blanked as expected_empty, as are all where none is
    selected; a winner out of several carries field_family_conflict. The confidence is
    the least positive one of the family.
    """
    w = Window.partitionBy("doc_id", "family")
    chosen = F.max(F.when(F.col("selected"), F.struct(F.col("confidence"), (-F.col("ord")).alias("o")))).over(w)
    wins = F.col("selected") & (F.col("chosen.confidence") == F.col("confidence")) & (F.col("chosen.o") == -F.col("ord"))
    marked = options.withColumn("chosen", chosen).withColumn("n", F.count_if("selected").over(w)).withColumn("low", F.min(F.when(F.col("confidence") > 0, F.col("confidence"))).over(w))
    wins = F.coalesce(wins, F.lit(False))
    return marked.select("doc_id", "family", "ord", "key", F.when(wins, "yes").otherwise("").alias("value"), F.coalesce("low", "confidence").alias("confidence"), F.when(~wins, "expected_empty").when(F.col("n") > 1, "field_family_conflict").otherwise("").alias("reason"))


def preferred(values: DataFrame, keys: list[str]) -> DataFrame:
    """One value of each key: in order, a later one replaces the current if it is preferred.

    Preferred: not blank over blank; then a confidence higher by more than 0.05; then a text as long or longer. The
    margin is not transitive, so this is a fold over the ordered values, not a maximum. values: keys, ord, value, confidence.
    """
    full = lambda x: F.length(F.trim(x["value"]))

    def step(best: Column, x: Column) -> Column:
        gap = x["confidence"] - best["confidence"]
        takes = F.when(best["ord"].isNull(), True).when((full(x) > 0) != (full(best) > 0), full(x) > 0).when(F.abs(gap) > 0.05, gap > 0).otherwise(full(x) >= full(best))
        return F.when(takes, x).otherwise(best)

    kind = "struct<ord:bigint,value:string,confidence:double>"
    item = F.struct(F.col("ord").cast("long").alias("ord"), F.coalesce("value", F.lit("")).alias("value"), F.col("confidence").cast("double").alias("confidence"))
    best = F.aggregate(F.array_sort(F.collect_list(item)), F.struct(F.lit(None), F.lit(""), F.lit(0.0)).cast(kind), step)
    return values.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.ord", "b.value", "b.confidence")


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the highest confidence, then the longest value, then the first. candidates: keys, ord, value, confidence."""
    rank = F.struct("confidence", F.length("value"), -F.col("ord"))
    return candidates.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), rank).alias("b")).select(*keys, "b.value", "b.confidence")


def gather_evidence(values: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, field_key, candidates, conflict, unresolved of each value and what a second reading of its region gave."""
    r = regions.select("doc_id", "field_key", F.struct("value", "confidence", "source").alias("r"))
    joined = values.select("doc_id", "field_key", F.struct("value", "confidence", "source").alias("v")).join(r, ["doc_id", "field_key"], "left")
    text = lambda c: F.trim(F.coalesce(F.col(f"{c}.value"), F.lit("")))
    both = F.when(text("r") != "", F.array("v", "r")).otherwise(F.array("v"))
    return joined.select("doc_id", "field_key", both.alias("candidates"), ((text("v") != "") & (text("r") != "") & (text("v") != text("r"))).alias("conflict"), (text("v") == "").alias("unresolved"))


def resolve_values(current: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """doc_id, field_key, value, confidence: an adjudicated value fills a missing key, or replaces one with no more confidence unless it is blank."""
    a = adjudicated.select("doc_id", "field_key", F.struct("value", "confidence").alias("a"))
    c = current.select("doc_id", "field_key", F.struct("value", "confidence").alias("c"))
    takes = F.col("c").isNull() | ((F.trim("a.value") != "") & (F.col("a.confidence") >= F.col("c.confidence")))
    pick = F.when(F.coalesce(takes & F.col("a").isNotNull(), F.lit(False)), F.col("a")).otherwise(F.col("c"))
    return c.join(a, ["doc_id", "field_key"], "full").withColumn("p", pick).select("doc_id", "field_key", "p.value", "p.confidence")


#: What a field's readings are called and how far each is trusted, in the order in which they are looked at.
READINGS = (("page_value", "page_candidate", 0.45), ("page_precision_value", "page_precision", 0.5), ("crop_value", "crop_candidate", 0.55), ("crop_precision_value", "crop_precision", 0.6))


def evidence_candidates(values: DataFrame, readings: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, key, page_number, anchor, candidates, value, reason: what is known of each value, with its distinct readings in order.

    values: doc_id, key, value, raw_text, source_kind, confidence; readings: doc_id, key and the columns of ``READINGS``; fields: doc_id, key, name, page_number, ord, of
    which the first of a key counts; pages: doc_id, page_number, text. Of equal readings the first stays; blank and null ones are none.
    """
    first = fields.groupBy("doc_id", "key").agg(F.min_by(F.struct("name", "page_number"), "ord").alias("f"))
    rows = values.join(readings, ["doc_id", "key"], "left").join(first, ["doc_id", "key"], "left").withColumn("page_number", F.coalesce("f.page_number", F.lit(1)))
    rows = rows.join(pages.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "page_number", F.lit(True).alias("_read")), ["doc_id", "page_number"], "left")
    reading = lambda c, source, trust: F.struct(F.trim(F.coalesce(c, F.lit(""))).alias("value"), F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"), trust.cast("double").alias("confidence"))
    every = F.array(reading(F.col("raw_text"), F.col("source_kind"), F.col("confidence")), *[reading(F.col(c), source, F.lit(trust)) for c, source, trust in READINGS])
    full = F.filter(every, lambda r: r["value"] != "")
    spelled = F.transform(full, lambda r: r["value"])
    distinct = F.filter(full, lambda r, i: F.array_position(spelled, r["value"]) == i + 1)
    reason = F.concat("source_kind", F.when(F.col("_read"), "+transcript").otherwise(""))
    return rows.select("doc_id", "key", "page_number", F.coalesce("f.name", "key").alias("anchor"), distinct.alias("candidates"), "value", reason.alias("reason"))
