"""What a document is: keyword signals, language, family, profile, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, text

#: Words looked for, as parts of the normalised text.
TURKISH = ["ogrenci", "dilekce", "basvuru", "ad", "soyad", "adres", "tarih", "danisman", "fakulte", "bolum", "program", "gano", "kredi", "e posta", "eposta"]
ENGLISH = ["student", "request", "application", "address", "date", "advisor", "incident", "witness", "claim", "consent", "email", "phone"]
PETITION = ["ogrenci", "student", "dilekce", "petition", "tek ders", "tek ders basvuru formu", "tek ders sinavina girecegi ders bilgileri", "ogrenci dilekce formu", "student number", "ogrenci no", "adi ve soyadi", "tel no e posta", "ad soyad", "ders kodu", "dersin adi", "department programme", "bolum program", "danisman", "gano"]
INSURANCE = ["incident", "witness", "injured", "driver", "passport", "date of report", "describe the incident"]
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"


def hits(plain: Column, words: list[str]) -> Column:
    """How many of ``words`` are parts of the text."""
    return sum((plain.contains(w).cast("int") for w in words[1:]), plain.contains(words[0]).cast("int"))


def signals(pages: DataFrame) -> DataFrame:
    """doc_id with keyword counts, each once a page, and the whole normalised text; pages: doc_id, page_number, text."""
    plain = pages.select("doc_id", "page_number", text.normalize_text(F.col("text")).alias("plain"), (F.length("text") - F.length(F.translate("text", TURKISH_LETTERS, ""))).alias("letters"))
    return plain.groupBy("doc_id").agg(
        F.sum(hits(F.col("plain"), TURKISH)).alias("turkish_words"), F.sum(F.coalesce("letters", F.lit(0))).alias("turkish_letters"), F.sum(hits(F.col("plain"), ENGLISH)).alias("english_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("plain") != "", F.struct("page_number", "plain")))), lambda p: p["plain"]), "\n").alias("plain"),
    )


def language(turkish_words: Column, turkish_letters: Column, english_words: Column) -> Column:
    t, e = turkish_words + F.least(turkish_letters, F.lit(8)), english_words
    return F.when((t >= 4) & (e >= 4), "mixed").when((t > e) & (t >= 2), "tr").when((e > t) & (e >= 2), "en").otherwise("unknown")


def family(plain: Column) -> Column:
    some = lambda *words: hits(plain, list(words)) > 0
    return (
        F.when(plain == "", "unknown")
        .when(hits(plain, PETITION) >= 3, "student_petition")
        .when(hits(plain, INSURANCE) >= 3, "insurance_incident")
        .when(some("consent", "acik riza", "onay formu"), "consent_form")
        .when(some("claim", "basvuru", "application"), "application_form")
        .otherwise("generic_form")
    )


def domain(family_: Column, plain: Column) -> Column:
    school = hits(plain, ["universite", "faculty", "fakulte", "student affairs"]) > 0
    return F.when((family_ == "student_petition") | school, "education").when(family_ == "insurance_incident", "insurance").when((family_ == "consent_form") | plain.contains("employee"), "hr").when(family_ == "application_form", "operations").otherwise("unknown")


def layout_style(underlines: Column, rects: Column) -> Column:
    return F.when((underlines >= 6) & (rects >= 4), "mixed").when(underlines >= 6, "underline_form").when(rects >= 6, "boxed_form").when(rects >= 2, "table_form").otherwise("unknown")


def profile(language_: Column, script: Column, family_: Column) -> Column:
    return F.when((family_ == "student_petition") & language_.isin("tr", "mixed"), "student_petition_tr").when((family_ == "insurance_incident") & language_.isin("en", "mixed"), "insurance_incident_en").when(script == "handwritten", "generic_handwritten_form").otherwise("generic_printed_form")


def identity_confidence(language_: Column, layout: Column, family_: Column) -> Column:
    known = F.when(family_ == "generic_form", 0.15).when(family_ == "unknown", 0.0).otherwise(0.35)
    return F.least(F.lit(0.95), F.lit(0.25) + F.when(language_ != "unknown", 0.2).otherwise(0.0) + F.when(layout != "unknown", 0.2).otherwise(0.0) + known)


def routing_strategy(pages: DataFrame) -> DataFrame:
    """doc_id, max_chars, min_chars, strategy from the characters embedded in each page."""
    by = pages.groupBy("doc_id").agg(F.max("chars").alias("max_chars"), F.min("chars").alias("min_chars"))
    return by.withColumn("strategy", F.when((F.col("max_chars") >= 50) & (F.col("min_chars") >= 20), "structure_first").when(F.col("max_chars") < 20, "vision_first").otherwise("hybrid"))


def route(kind: Column, existing: Column, detected: Column) -> Column:
    return F.when((kind == "acroform") & (existing > 0), "existing_acroform").when((kind == "flat") & (detected > 0), "blank_template").when(kind == "flat", "filled_document").otherwise("low_confidence_review")


def reviewed_route(route_: Column, asked: Column, confidence_: Column) -> Column:
    return F.when(asked | (confidence_ < 0.45), "low_confidence_review").otherwise(route_)


def classify(existing: Column, detected: Column, chars: Column, pages: Column) -> Column:
    """The classification from counts alone: kind, route and confidence."""
    score = F.when(existing > 0, 0.9).when(detected > 0, 0.72).when(chars > 600, 0.64).when(pages > 0, 0.55).otherwise(0.25)
    way = F.when(existing > 0, "existing_acroform").when(detected > 0, "blank_template").otherwise("filled_document")
    return F.struct(F.when(existing > 0, "acroform").otherwise("flat").alias("document_kind"), way.alias("route_hint"), score.alias("confidence"), (score < 0.45).alias("review_required"))


def coerced(value: Column, allowed: list[str], fallback: Column) -> Column:
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(allowed), plain).otherwise(fallback)


def merged_confidence(analysed: Column, classified: Column) -> Column:
    return confidence.blended(analysed, classified)


def text_density(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, density: characters other than white space over 1200, 1 at most."""
    compact = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    return pages.select("doc_id", "page_number", F.least(F.lit(1.0), compact / 1200.0).alias("density"))
