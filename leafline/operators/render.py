"""The render plan of a document: which writer fills each field, where and how large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from .layout import TINY_HEIGHT, TINY_WIDTH

#: Parts of names that call for a writer, in the order in which they are looked for.
DATE_SIGNATURE_HINTS = ("tarih", "date", "sign", "signature", "imza", "danisman_tarih_imza", "mali_onay_tarih_imza")
CONTACT_HINTS = ("telefon", "e_posta", "email", "e_mail", "contact", "fax")
TABLE_HINTS = ("ders_kodu", "ders_adi", "ders_kredisi", "akts", "ders_notu", "mali_onay_ders_akts")
MULTILINE_HINTS = ("aciklama", "açiklama", "opinion", "gorusu", "görusu", "description", "notes", "adres", "witness", "incident")
INLINE_HINTS = ("ad_soyad", "fakulte_birim", "ogrenci_no", "egitim_yili", "yariyil", "bolum_program", "danisman_adi", "gno", "donem_sayisi", "mali_onay_ad_soyad")
#: The container of each writer.
CONTAINERS = {"table_cell": "table_cell", "multiline": "multiline_block", "date_signature": "date_signature_block", "compound_contact": "compound_contact_row", "inline": "inline_run", "single_line": "single_line_field"}
#: A writer's share of a box's height as font size, the least and the largest size.
FONT = {"multiline": (0.36, 6.0, 12.0), "inline": (0.68, 6.5, 12.0), "other": (0.75, 6.0, 12.0), "lines": (0.30, 6.0, 11.0)}

SPEC = "profile string, name string, spec_box struct<left:double,top:double,right:double,bottom:double>, font_size double, multiline_font_size double, baseline_inset double"


def _any(name: Column, hints: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | name.contains(hint)
    return found


def writer(name: Column, kind: Column, box: Column, petition: Column, font_size: Column, multiline_font_size: Column) -> Column:
    """The writer of a field, by its kind, then its name, then what the profile says of it, then its box."""
    plain = F.lower(F.trim(name))
    small = font_size.isNotNull() & (g.height(box) <= 18) & (g.width(box) <= 210)
    return (
        F.when(kind == "multiline", "multiline")
        .when(kind.isin("date", "signature") | _any(plain, DATE_SIGNATURE_HINTS), "date_signature")
        .when(_any(plain, CONTACT_HINTS), "compound_contact")
        .when(_any(plain, TABLE_HINTS), "table_cell")
        .when(_any(plain, MULTILINE_HINTS), "multiline")
        .when(petition & _any(plain, INLINE_HINTS), "inline")
        .when(multiline_font_size.isNotNull(), "multiline")
        .when(box.isNotNull() & small, "inline")
        .when(box.isNotNull() & (g.height(box) >= 26), "multiline")
        .otherwise("single_line")
    )


def _size(box: Column, rule: str) -> Column:
    share, least, most = FONT[rule]
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(g.height(box) * share, 1)))


#: What parts contacts, and a date in a text.
CONTACT_PARTS, DATE_WITHIN = r"\s*[/;|\n]\s*", r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b"
_RUNS = "array<struct<text:string,role:string>>"


def runs(way: Column, value: Column) -> Column:
    """array<struct<text, role>>: what a writer writes of a value, in order. Joined with what parts them, the texts give the value but for its white space.

    Contacts are parted and named by what they hold; a date and a signature by the first slash; long texts by lines. A blank value has no runs.
    """
    plain = text.squeeze(value)
    one = lambda c, role: F.struct(c.alias("text"), (F.lit(role) if isinstance(role, str) else role).alias("role"))
    filled = lambda xs: F.filter(xs, lambda x: x["text"] != "")
    body = F.array(one(plain, "body"))
    named = lambda x: F.when(x.rlike(f"(?i){text.EMAIL}"), "email").when(x.rlike(text.PHONE), "phone").otherwise("body")
    contact = filled(F.transform(F.split(plain, CONTACT_PARTS), lambda x: one(x, named(x))))
    slash = F.instr(plain, "/")
    halves = filled(F.array(one(text.strip(F.left(plain, slash - 1)), "date"), one(text.strip(F.substring(plain, slash + 1, F.length(plain))), "signature")))
    dated = F.when((slash > 0) & (F.size(halves) > 0), halves).when(plain.rlike(DATE_WITHIN), F.array(one(plain, "date"))).otherwise(body)
    kept = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\r\n|\r|\n"), text.squeeze), lambda x: x != "")
    lines = F.transform(kept, lambda x, i: one(x, F.concat(F.lit("line_"), (i + 1).cast("string"))))
    none = F.array().cast(_RUNS)
    found = F.when(way == "compound_contact", F.when(F.size(contact) > 0, contact).otherwise(body)).when(way == "date_signature", dated).when(way == "multiline", lines).otherwise(body)
    return F.when(plain == "", none).otherwise(found.cast(_RUNS))


def plan(fields: DataFrame, values: DataFrame, specs: DataFrame) -> DataFrame:
    """A row a field in reading order: doc_id, place, name, writer, container, value, target, font_size, multiline_font_size, baseline, anchor, warnings, runs.

    fields: doc_id, profile, name, kind, box (page_number, left, top, right, bottom); values: doc_id, name, value; ``specs`` (``SPEC``) say where and how large a profile
    writes a field, instead of its own box (the target is then the profile's, so no warning can name a difference between them). A field without a box has neither sizes nor a baseline; a missing value is blank.
    """
    rows = fields.join(F.broadcast(specs), ["profile", "name"], "left").join(values.select("doc_id", "name", "value"), ["doc_id", "name"], "left")
    box, spec = F.col("box"), F.col("spec_box")
    petition = F.col("profile") == "student_petition_tr"
    rows = rows.withColumn("writer", writer(F.col("name"), F.col("kind"), box, petition, F.col("font_size"), F.col("multiline_font_size")))
    page = F.coalesce(box["page_number"], F.lit(1)).alias("page_number")
    target = F.when(spec.isNotNull(), F.struct(page, *[spec[c].alias(c) for c in ("left", "top", "right", "bottom")])).otherwise(F.when(box.isNotNull(), F.struct(*[box[c].alias(c) for c in ("page_number", "left", "top", "right", "bottom")])))
    rows = rows.withColumn("target", target)
    way, aim = F.col("writer"), F.col("target")
    size = F.when(box.isNotNull(), F.when(way == "multiline", _size(box, "multiline")).when(way == "inline", _size(box, "inline")).otherwise(_size(box, "other")))
    lines = F.when(box.isNotNull() & (way == "multiline"), _size(box, "lines"))
    warnings = F.when(box.isNull(), F.array(F.lit("missing_detected_region"))).otherwise(
        F.array_compact(F.array(
            F.when((g.width(aim) < TINY_WIDTH) | (g.height(aim) < TINY_HEIGHT), "tiny_target_region"),
            F.when((way == "multiline") & (g.height(box) < 20), "multiline_writer_on_short_region"),
        ))
    )
    order = Window.partitionBy("doc_id").orderBy(*[box[c].asc_nulls_last() for c in ("page_number", "top", "left")], "name")
    containers = F.create_map(*[F.lit(x) for pair in CONTAINERS.items() for x in pair])
    return rows.select(
        "doc_id", F.row_number().over(order).alias("place"), "name", "writer", F.element_at(containers, way).alias("container"), F.trim(F.coalesce("value", F.lit(""))).alias("value"), "target",
        F.coalesce("font_size", size).alias("font_size"), F.coalesce("multiline_font_size", lines).alias("multiline_font_size"),
        F.when(aim.isNotNull(), F.greatest(aim["top"], aim["bottom"] - F.coalesce("baseline_inset", F.lit(0.8)))).alias("baseline"),
        F.concat_ws(":", F.nullif("profile", F.lit("")), F.lower(F.trim("name"))).alias("anchor"), warnings.alias("warnings"), runs(way, F.col("value")).alias("runs"),
    )


def plan_summary(items: DataFrame) -> DataFrame:
    """doc_id, writer, fields, pages, warnings of a plan: fields of each writer, with the document's last page and its distinct warnings."""
    by = items.groupBy("doc_id").agg(F.max("target.page_number").alias("pages"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))), ",").alias("warnings"))
    return items.groupBy("doc_id", "writer").agg(F.count("*").alias("fields")).join(by, "doc_id")
