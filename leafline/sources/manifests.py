"""Readers of benchmark manifests and annotations, and a check of what kind of file some bytes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import last_value_first_place
from ..operators.sampling import split_of

FIELD = "STRUCT<key STRING, value STRING, kind STRING, page_number INT, box ARRAY<DOUBLE>>"
PAGE = f"STRUCT<page_number INT, width INT, height INT, expected_fields ARRAY<{FIELD}>>"
MANIFEST = f"sample_id STRING, split STRING, page_number INT, page {PAGE}, pages ARRAY<{PAGE}>, expected_fields ARRAY<{FIELD}>"
ANNOTATIONS = "image_id INT, bbox ARRAY<DOUBLE>, score DOUBLE, category_id INT, image_name STRING, text STRING"
#: Annotation categories, in order.
CATEGORIES = {0: "Police Station", 1: "Year", 2: "Statutes", 3: "Complainant Name"}
#: First bytes of the kinds of files.
MAGIC = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A")]


def read_manifest(spark: SparkSession, path: str, dataset: str, split: str = "all") -> DataFrame:
    """Samples of a JSON manifest: dataset, split, sample_id, pages, expected_fields."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return manifest_samples(rows, dataset, split)


def manifest_samples(rows: DataFrame, dataset: str, split: str = "all") -> DataFrame:
    own = rows.withColumn("split", F.coalesce("split", F.lit("test")))
    pages = F.when(F.size("pages") > 0, F.col("pages")).when(F.col("page").isNotNull(), F.array("page"))
    # numbered within each input partition, from where the partitions before it end
    unnamed = own.where("sample_id is null or sample_id = ''").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = unnamed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_row")) - 1
    index = (F.col("_before") + within).cast("string")
    unnamed = unnamed.join(offsets, "_part").withColumn("sample_id", F.concat_ws(":", F.lit(dataset), "split", index)).select(*own.columns)
    numbered = own.where("sample_id <> ''").unionByName(unnamed)
    out = numbered.select(F.lit(dataset).alias("dataset"), "split", "sample_id", "page_number", pages.alias("pages"), "expected_fields")
    return out if split == "all" else out.where(F.col("split") == split)


def manifest_fields(samples: DataFrame) -> DataFrame:
    """dataset, split, sample_id, ord, key, page_number, value: expected fields of the pages.

    The sample's own fields stand in once, for the first page, if that has none. Of repeated (key, page) the last
    value stays, at the first place.
    """
    keys = ["dataset", "split", "sample_id"]
    one = F.struct(F.coalesce("page_number", F.lit(1)).alias("page_number"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast(f"ARRAY<{FIELD}>").alias("expected_fields"))
    paged = samples.select(*keys, "expected_fields", F.posexplode(F.coalesce("pages", F.array(one))).alias("at", "p"))
    fields = F.coalesce("p.expected_fields", F.when(F.col("at") == 0, F.col("expected_fields")))
    long = paged.select(*keys, "at", F.coalesce("p.page_number", F.col("at") + 1).alias("page"), F.posexplode(fields).alias("k", "f"))
    flat = long.select(*keys, (F.col("at") * 1_000_000 + F.col("k")).alias("ord"), F.col("f.key").alias("key"), F.coalesce("f.page_number", "page").alias("page_number"), F.struct(F.col("f.value"), F.coalesce("f.kind", F.lit("text")).alias("kind"), F.col("f.box")).alias("v"))
    return last_value_first_place(flat, [*keys, "key", "page_number"], "v", "ord").select(*keys, "ord", "key", "page_number", "v.value", "v.kind", "v.box")


def annotation_fields(rows: DataFrame, split: str = "all") -> DataFrame:
    """sample_id, key, value and box of annotated images: the texts of each category in reading order, with the box around them."""
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    known = rows.where(F.col("category_id").isin(*CATEGORIES) & F.col("text").rlike(r"(?U)\S"))
    known = known if split == "all" else known.where(split_of(F.col("image_name")) == split)
    box = lambda i: F.get("bbox", F.lit(i))
    grouped = known.groupBy(F.col("image_name").alias("sample_id"), "category_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(box(1).alias("top"), box(0).alias("left"), F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("value"),
        F.min(box(0)).alias("left"), F.min(box(1)).alias("top"), F.max(box(0) + box(2)).alias("right"), F.max(box(1) + box(3)).alias("bottom"),
    )
    return grouped.select("sample_id", F.element_at(names, F.col("category_id")).alias("key"), "value", F.struct("left", "top", "right", "bottom").alias("box"))


#: Words that a checkbox reads.
CHECK_WORDS = ("yes", "no", "true", "false", "on", "off", "checked", "unchecked")


def value_kind(value: Column) -> Column:
    """checkbox for a word of one, multiline for several lines, else text."""
    plain = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))
    return F.when(plain.isin(*CHECK_WORDS), "checkbox").when(value.contains("\n"), "multiline").otherwise("text")


def linked_fields(rows: DataFrame) -> DataFrame:
    """sample_id, key, value, kind, box of form-understanding rows: answers linked to each question, in order, on lines of their own.

    A group of words has the label that most of them have; ties go to the smallest. Label 2 is a question, 3 an answer. The
    box is the one around all answers of a question; without boxes it is null. rows: sample_id, words, labels, grouped_words, linked_groups, and bboxes if there are any.
    """
    boxes = F.col("bboxes") if "bboxes" in rows.columns else F.lit(None).cast("array<array<double>>")
    text = lambda ids: F.trim(F.array_join(F.transform(ids, lambda i: F.get("words", i)), " "))

    def label(ids: Column) -> Column:
        own = F.transform(ids, lambda i: F.get("labels", i))
        votes = F.transform(F.array_distinct(own), lambda v: F.struct((-F.size(F.filter(own, lambda x: x == v))).alias("n"), v.cast("int").alias("label")))
        return F.array_min(votes)["label"]

    edge = lambda ids, side, pick: pick(F.filter(F.transform(ids, lambda i: F.get(F.get("bboxes", i), F.lit(side)).cast("double")), lambda x: x.isNotNull()))
    around = lambda ids: F.struct(edge(ids, 0, F.array_min).alias("left"), edge(ids, 1, F.array_min).alias("top"), edge(ids, 2, F.array_max).alias("right"), edge(ids, 3, F.array_max).alias("bottom"))
    pairs = rows.select("sample_id", "words", "labels", "grouped_words", boxes.alias("bboxes"), F.posexplode("linked_groups").alias("ord", "link"))
    a, b = F.get("grouped_words", F.get("link", F.lit(0))), F.get("grouped_words", F.get("link", F.lit(1)))
    side = lambda ids: F.struct(label(ids).alias("label"), text(ids).alias("text"), around(ids).alias("box"))
    sides = pairs.select("sample_id", "ord", side(a).alias("a"), side(b).alias("b")).where("(a.label = 2 and b.label = 3) or (a.label = 3 and b.label = 2)")
    asks = F.col("a.label") == 2
    long = sides.select("sample_id", "ord", F.when(asks, F.col("a.text")).otherwise(F.col("b.text")).alias("key"), F.when(asks, F.col("b")).otherwise(F.col("a")).alias("v")).where("key <> '' and v.text <> ''")
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "v.text"))), lambda x: x["text"]), "\n")
    whole = F.struct(F.min("v.box.left").alias("left"), F.min("v.box.top").alias("top"), F.max("v.box.right").alias("right"), F.max("v.box.bottom").alias("bottom"))
    found = long.groupBy("sample_id", "key").agg(value.alias("value"), whole.alias("box"))
    return found.select("sample_id", "key", "value", value_kind(F.col("value")).alias("kind"), F.when(F.col("box.left").isNotNull(), F.col("box")).alias("box"))


def file_kind(content: Column) -> Column:
    """pdf, png, jpeg, tiff, webp, json or unknown, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")
    for kind, magic in MAGIC:
        out = out.when(head.startswith(magic), kind)
    start = F.regexp_extract(F.substring(content, 1, 64).cast("string"), r"^\s*([\{\[])", 1)
    return out.when(start != "", "json").otherwise("unknown")


def checked_input(files: DataFrame, allowed: list[str], most_bytes: int) -> DataFrame:
    """``files`` (path, content) with kind and error: empty, too_large, unsupported or null."""
    kind = file_kind(F.col("content"))
    size = F.octet_length("content")
    return files.select("path", kind.alias("kind"), F.when(size == 0, "empty").when(size > most_bytes, "too_large").when(~kind.isin(allowed), "unsupported").alias("error"))


def payload_values(payloads: DataFrame) -> DataFrame:
    """doc_id, source_key, value, confidence from JSON with ``fields`` as a list of objects, or as an object of values or objects."""
    kind = "ARRAY<STRUCT<key STRING, value STRING, confidence DOUBLE>>"
    listed = F.from_json(F.get_json_object("payload", "$.fields"), kind)
    mapped = F.from_json(F.get_json_object("payload", "$.fields"), "MAP<STRING, STRING>")
    is_list = F.get_json_object("payload", "$.fields").startswith("[")
    one = payloads.where(is_list).select("doc_id", F.explode(listed).alias("f")).select("doc_id", F.col("f.key").alias("source_key"), F.col("f.value").alias("value"), F.col("f.confidence").alias("confidence"))
    two = payloads.where(~is_list).select("doc_id", F.explode(mapped).alias("source_key", "raw"))
    inner = F.from_json("raw", "STRUCT<value STRING, confidence DOUBLE>")
    nested = F.col("raw").startswith("{")
    return one.unionByName(two.select("doc_id", "source_key", F.when(nested, inner["value"]).otherwise(F.col("raw")).alias("value"), F.when(nested, inner["confidence"]).alias("confidence")))
