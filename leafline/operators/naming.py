"""Names of fields: reviews, renames, kinds and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import dedup

#: Fixed value: what is said of a name that fails its review.
REASON = "Field name should be semantic, slugified, and unique."
#: Kinds of form fields by their code, kinds by the words that models use, and words of a ticked box.
CODES = {"/Btn": "checkbox", "/Tx": "text", "/Sig": "signature", "/Ch": "text"}
KINDS = {"checkbox": "checkbox", "check": "checkbox", "radio": "radio", "signature": "signature", "date": "date", "number": "number", "numeric": "number", "multiline": "multiline", "textarea": "multiline", "text": "text"}
TICKED = ("1", "true", "yes", "y", "on", "checked", "selected", "x")
#: Headers of table cells that hold dates and numbers.
DATES, NUMBERS = ("date", "tarih"), ("no", "numara", "number", "akts", "kredi", "credit")
#: Parts of names and the footnote that they get.
FOOTNOTES = {"incident": "Incident", "witness": "Witnesses", "injur": "Injuries", "address": "Address"}


def name_reviews(fields: DataFrame) -> DataFrame:
    """doc_id, ord, current_name, recommended_name, is_valid, reason of fields (doc_id, ord, name, label): a name is right if it says something and is its label's unique slug."""
    rows = fields.select("doc_id", "ord", F.col("name").alias("current_name"), F.coalesce(F.nullif("label", F.lit("")), "name").alias("label"))
    names = dedup.unique_names(rows, ["doc_id"], "ord", "label").withColumnRenamed("name", "recommended_name")
    valid = F.coalesce(text.is_semantic_name(F.col("current_name")) & (F.col("current_name") == F.col("recommended_name")), F.lit(False))
    return rows.drop("label").join(names, ["doc_id", "ord"]).select("doc_id", "ord", "current_name", "recommended_name", valid.alias("is_valid"), F.when(valid, "").otherwise(REASON).alias("reason"))


def renames(reviews: DataFrame) -> DataFrame:
    """doc_id, current_name, recommended_name of names that are to change; of a repeated name the last review."""
    moved = reviews.where(~F.col("is_valid") & (F.col("current_name") != F.col("recommended_name")))
    return moved.groupBy("doc_id", "current_name").agg(F.max_by("recommended_name", "ord").alias("recommended_name"))


def renames_of_mappings(mappings: DataFrame) -> DataFrame:
    """doc_id, target_field, name: the unique slug of the source of each target of mappings (doc_id, ord, source_key, target_field); the last of a target counts."""
    rows = mappings.where("target_field <> ''")
    names = dedup.unique_names(rows, ["doc_id"], "ord", "source_key")
    return rows.join(names, ["doc_id", "ord"]).groupBy("doc_id", "target_field").agg(F.max_by("name", "ord").alias("name"))


def detection_confidence(confidence: Column, has_cells: Column, layout_failed: Column) -> Column:
    """A detection is a little surer with table cells, and less so after an error of the layout."""
    more = F.when(has_cells, F.least(F.lit(1.0), confidence + 0.03)).otherwise(confidence)
    return F.when(layout_failed, F.greatest(F.lit(0.0), more - 0.05)).otherwise(more)


def _kind(pattern: str, kind: str, confidence: float) -> Column:
    return F.struct(F.lit(pattern).alias("pattern"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def placeholder_kind(value: Column) -> Column:
    """struct pattern, kind, confidence of a text that marks where to write."""
    t = text.strip(value)
    has, long = lambda s: F.contains(t, F.lit(s)), F.length(t) >= 5
    return (
        F.when(has(":") & has("."), _kind("colon_dots", "text", 0.74))
        .when(has(".") & long, _kind("bare_dots", "text", 0.7))
        .when(has("_") & long, _kind("underline", "text", 0.7))
        .when(has("/") & has("20"), _kind("placeholder", "date", 0.72))
        .otherwise(_kind("unknown", "unknown", 0.0))
    )


def rect_kind(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """struct pattern, kind, confidence of a drawn box."""
    w, h = F.abs(x1 - x0), F.abs(bottom - top)
    return F.when((w <= 15) & (h <= 15) & (F.abs(w - h) <= 4), _kind("checkbox", "checkbox", 0.82)).when((w >= 45) & (h <= 18), _kind("rect_box", "text", 0.65)).otherwise(_kind("unknown", "unknown", 0.0))


def cell_kind(header: Column, width: Column) -> Column:
    """struct pattern, kind, confidence of a table cell under a header."""
    plain = text.normalize_text(header)
    holds = lambda words: plain.rlike("|".join(words))
    kind = F.when(holds(DATES), "date").when(holds(NUMBERS), "number").otherwise("text")
    return F.struct(F.lit("table_cell").alias("pattern"), kind.alias("kind"), F.when(width > 24, 0.74).otherwise(0.58).alias("confidence"))


def _mapped(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit("unknown"))


def kind_of_code(code: Column) -> Column:
    return _mapped(code, CODES)


def kind_of_word(word: Column) -> Column:
    return _mapped(F.lower(text.strip(word)), KINDS)


def is_ticked(value: Column) -> Column:
    return F.coalesce(F.lower(text.strip(value)).isin(*TICKED), F.lit(False))


def _spoken(name: Column) -> Column:
    return text.strip(F.replace(F.replace(name, F.lit("__body"), F.lit("")), F.lit("_"), F.lit(" ")))


def display_label(name: Column) -> Column:
    """A name as a title; letters after anything that is no letter are capitals."""
    parts = F.regexp_extract_all(_spoken(name), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")
    return F.when(_spoken(name) == "", "Continued Field").otherwise(titled)


def footnote_label(name: Column) -> Column:
    """What a note on a page calls the field that it goes on from."""
    plain, out = F.lower(_spoken(name)), None
    for part, label in FOOTNOTES.items():
        out = (F if out is None else out).when(plain.contains(part), label)
    return out.otherwise(F.substring_index(text.squeeze(display_label(name)), " ", 2))


def anchor_key(value: Column) -> Column:
    return F.left(F.replace(F.lower(text.squeeze(value)), F.lit(" "), F.lit("_")), F.lit(80))


def safe_folder(value: Column) -> Column:
    """A sample's name as that of a folder."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit("sample"))
