"""Fields of petition pages: a table of specifications, of which each page takes those of its variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import written
from . import anchors, dedup

SINGLE, GENERIC = "single_course_application", "generic_student_petition"
#: What the text of a page of the single-course variant holds, one of these or all of the last.
SINGLE_TEXTS = ("tek ders basvuru formu", "tek ders sinavina girecegi ders bilgileri")
SINGLE_WORDS = ("tek ders", "formu", "ders kodu")

#: Fixed values, in order: variant, kind of specification, field, terms, kind of field, strategy, least width, height, confidence.
_RIGHT, _BELOW, _ABOVE = "underline_right", "underline_below", "underline_above"
SPECS = [
    (GENERIC, "anchor", "tarih", ("Tarih", "Date"), "date", _ABOVE, 110.0, 28.0, 0.88),
    (GENERIC, "anchor", "ogrenci_no", ("Öğrenci No", "Student Number"), "text", _BELOW, 180.0, 30.0, 0.88),
    (GENERIC, "anchor", "tc_kimlik_no", ("T.C. Kimlik No", "TR Identity Number"), "text", _RIGHT, 220.0, 30.0, 0.88),
    (GENERIC, "anchor", "fakulte_birim", ("Fakülte/Yüksekokul/", "Unit"), "text", _BELOW, 220.0, 30.0, 0.88),
    (GENERIC, "anchor", "ad_soyad", ("Ad Soyad", "First & Last Name"), "text", _RIGHT, 220.0, 30.0, 0.88),
    (GENERIC, "anchor", "bolum_program", ("Bölüm/Program", "Department/Programme"), "text", _RIGHT, 220.0, 30.0, 0.88),
    (GENERIC, "anchor", "telefon", ("Cep Telefon No", "GSMNumber"), "text", _RIGHT, 220.0, 30.0, 0.88),
    (GENERIC, "anchor", "gano", ("GANO", "GPA"), "number", _RIGHT, 110.0, 30.0, 0.88),
    (GENERIC, "anchor", "e_posta", ("E-Posta Adresi", "E-mail Address"), "text", _RIGHT, 260.0, 30.0, 0.88),
    (GENERIC, "anchor", "tamamlanan_kredi", ("Tamamlanan Kredi", "Credits Completed"), "number", _RIGHT, 130.0, 30.0, 0.88),
    (GENERIC, "cell", "ders_kodu", ("Ders Kodu",), "text", "", 0.0, 0.0, 0.84),
    (GENERIC, "cell", "ders_adi", ("Dersin Adı",), "text", "", 0.0, 0.0, 0.84),
    (GENERIC, "cell", "ders_kredisi", ("Dersin Kredisi",), "number", "", 0.0, 0.0, 0.84),
    (GENERIC, "cell", "akts", ("AKTS",), "number", "", 0.0, 0.0, 0.84),
    (GENERIC, "cell", "ders_notu", ("Ders Notu",), "text", "", 0.0, 0.0, 0.84),
    (GENERIC, "section", "ogrenci_aciklamasi", ("Öğrencinin Açıklaması", "Student's Explanation"), "multiline", "", 0.0, 0.0, 0.80),
    (GENERIC, "section", "danisman_gorusu", ("Öğretim Üyesi/Danışman Görüşü",), "multiline", "", 0.0, 0.0, 0.80),
    (GENERIC, "signature", "ogrenci_imzasi", ("Öğrencinin İmzası", "Student's Signature"), "signature", "", 0.0, 0.0, 0.78),
    (GENERIC, "end", "ogrenci_aciklamasi", ("Ekler", "Attachments"), "", "", 0.0, 0.0, 0.0),
    (GENERIC, "end", "danisman_gorusu", ("İlgili Yönetim",), "", "", 0.0, 0.0, 0.0),
    (SINGLE, "anchor", "tarih", ("Tarih",), "date", _ABOVE, 96.0, 18.0, 0.90),
    (SINGLE, "anchor", "ad_soyad", ("Adı ve Soyadı", "Ad Soyad"), "text", _RIGHT, 280.0, 16.0, 0.90),
    (SINGLE, "anchor", "adres", ("Adres",), "multiline", _RIGHT, 320.0, 16.0, 0.90),
    (SINGLE, "anchor", "danisman_adi", ("Danışmanın Adı",), "text", _RIGHT, 210.0, 16.0, 0.90),
    (SINGLE, "anchor", "gno", ("GNO",), "number", _RIGHT, 58.0, 14.0, 0.90),
    (SINGLE, "anchor", "donem_sayisi", ("Öğrencinin dönem sayısı",), "number", _RIGHT, 44.0, 14.0, 0.90),
    (SINGLE, "anchor", "mali_onay_ders_akts", ("Ödenen Ders ve Kredi/AKTS Sayısı",), "text", _RIGHT, 96.0, 16.0, 0.90),
    (SINGLE, "anchor", "mali_onay_ad_soyad", ("Adı Soyadı",), "text", _RIGHT, 150.0, 16.0, 0.90),
    (SINGLE, "anchor", "mali_onay_tarih_imza", ("Tarih ve İmza",), "text", _RIGHT, 176.0, 16.0, 0.90),
    (SINGLE, "contact", "telefon", ("Tel No / E-posta",), "text", _RIGHT, 280.0, 22.0, 0.90),
]
#: Fixed value: the date of the single-course variant is looked for above this height only.
DATE_ABOVE = 220.0
#: Fixed values, in order: fields of the single-course variant at fixed places of the page.
FIXED = [
    ("fakulte_birim", "text", 186.0, 152.0, 322.0, 170.0), ("ogrenci_no", "text", 46.0, 198.0, 138.0, 214.0), ("egitim_yili", "text", 250.0, 197.0, 329.0, 214.0), ("yariyil", "text", 344.0, 197.0, 389.0, 214.0),
    ("bolum_program", "text", 332.0, 177.0, 519.0, 194.0), ("ogrenci_imzasi", "signature", 409.0, 319.0, 503.0, 338.0), ("ders_kodu", "text", 110.0, 385.0, 160.0, 419.0), ("ders_adi", "text", 160.0, 385.0, 356.0, 419.0),
    ("ders_kredisi", "number", 356.0, 385.0, 430.0, 419.0), ("akts", "number", 438.0, 385.0, 482.0, 419.0), ("ders_notu", "text", 492.0, 385.0, 533.0, 419.0), ("danisman_gorusu", "multiline", 168.0, 454.0, 476.0, 491.0),
    ("danisman_tarih_imza", "text", 94.0, 530.0, 340.0, 549.0),
]

#: Stands between the words of a page; in a word it counts as another control character.
_GAP = "\x00"
_PAGE = ["doc_id", "page_number"]
_EDGES = ["left", "top", "right", "bottom"]


def page_variants(words: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` with variant, by what the text of the page says. A page's words are one group."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda w: F.coalesce(w["word"], F.lit("")))
    said = words.groupBy(*_PAGE).agg(text.normalize_text(F.array_join(whole, " ")).alias("said"))
    single, every = F.lit(False), F.lit(True)
    for phrase in SINGLE_TEXTS:
        single = single | F.col("said").contains(phrase)
    for phrase in SINGLE_WORDS:
        every = every & F.col("said").contains(phrase)
    return pages.join(said, _PAGE, "left").withColumn("variant", F.when(single | every, SINGLE).otherwise(GENERIC)).drop("said")


def spec_table(spark) -> DataFrame:
    """The specifications as a table with their order, a fixed number of rows."""
    rows = [(v, i, k, f"{v}/{k}/{name}", name, list(terms), kind, way, w, h, c) for i, (v, k, name, terms, kind, way, w, h, c) in enumerate(SPECS)]
    return spark.createDataFrame(rows, "variant string, rank int, part string, spec string, label string, terms array<string>, kind string, strategy string, min_width double, height double, confidence double")


def _term_lists(specs: DataFrame) -> DataFrame:
    """variant, asked: its specifications with their terms as they read in a page's words, a fixed number of rows.

    Words that spell a term may hold more before its first and after its last word, so it is a part of the words with ``_GAP`` between.
    """
    upper = (F.col("variant") == SINGLE) & (F.col("label") == "tarih")
    words = lambda t: F.split(F.lower(t), " ")
    terms = F.transform("terms", lambda t: F.struct(F.array_join(words(t), _GAP).alias("said"), F.size(words(t)).alias("n"), upper.alias("upper")))
    return specs.groupBy("variant").agg(F.collect_list(F.struct("spec", terms.alias("terms"))).alias("asked"))


def printed_anchors(words: DataFrame, pages: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id, page_number, spec and edges of the printed terms of each page's variant: of each term the first place, of those the topmost, then leftmost.

    The date of the single-course variant has to stand in the upper part; there all places count. Case doesn't matter; a place is as large as its words.
    """
    lower = F.struct("ord", F.translate(F.lower("word"), _GAP, "\x01").alias("word"), *_EDGES)
    page = words.where("word is not null").groupBy(*_PAGE).agg(F.array_sort(F.collect_list(lower)).alias("ws")).withColumn("said", F.array_join(F.transform("ws", lambda w: w["word"]), _GAP))
    asked = page.join(pages.select(*_PAGE, "variant"), _PAGE).join(F.broadcast(_term_lists(specs)), "variant")
    top, left = lambda ws: F.array_min(F.transform(ws, lambda x: x["top"])), lambda ws: F.array_min(F.transform(ws, lambda x: x["left"]))
    right, bottom = lambda ws: F.array_max(F.transform(ws, lambda x: x["right"])), lambda ws: F.array_max(F.transform(ws, lambda x: x["bottom"]))
    box = lambda w: F.struct(top(w).alias("top"), left(w).alias("left"), right(w).alias("right"), bottom(w).alias("bottom"))

    def first(t: Column) -> Column:
        """The box of the first place: the text before it tells how many words are."""
        before = F.left("said", F.instr("said", t["said"]) - 1)
        return box(F.slice("ws", F.length(before) - F.length(F.replace(before, F.lit(_GAP), F.lit(""))) + 1, t["n"]))

    def topmost(t: Column) -> Column:
        """The least box of all places in the upper part."""
        windows = F.transform(F.sequence(F.lit(1), F.size("ws") - t["n"] + 1), lambda i: F.slice("ws", i, t["n"]))
        hit = lambda w: (F.get(w, F.lit(0))["top"] <= DATE_ABOVE) & (F.instr(F.array_join(F.transform(w, lambda x: x["word"]), _GAP), t["said"]) > 0)
        return F.array_min(F.transform(F.filter(windows, hit), box))

    place = lambda t: F.when(F.instr("said", t["said"]) > 0, F.when(t["upper"], topmost(t)).otherwise(first(t)))
    boxes = F.transform("asked", lambda s: F.struct(s["spec"].alias("spec"), F.array_min(F.transform(s["terms"], place)).alias("b")))
    found = asked.select(*_PAGE, F.inline(F.filter(boxes, lambda x: x["b"].isNotNull())))
    return found.select(*_PAGE, "spec", *[f"b.{c}" for c in _EDGES])


def find_anchors(words: DataFrame, pages: DataFrame, specs: DataFrame) -> DataFrame:
    """``printed_anchors``, and for specifications without one the phrase on the page that is most like a term, if it is like enough. Both are written tables."""
    printed = written(printed_anchors(words, pages, specs), "petition-printed")
    missing = pages.select(*_PAGE, "variant").join(F.broadcast(specs.select("variant", "spec", "label")), "variant").join(printed, [*_PAGE, "spec"], "left_anti")
    missing = written(missing, "petition-missing")
    if missing.isEmpty():
        return printed
    terms = [(f"{v}/{k}/{name}", term) for v, k, name, all_, *_ in SPECS for term in all_]
    like = anchors.anchor_phrases(words.join(missing.select(*_PAGE).distinct(), _PAGE, "left_semi"), terms).join(missing, [*_PAGE, "spec"])
    like = like.where((F.col("label") != "tarih") | (F.col("variant") != SINGLE) | (F.col("top") <= DATE_ABOVE))
    return printed.unionByName(written(like.select(*_PAGE, "spec", *_EDGES), "petition-like"))


def detect_petition_fields(words: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, page_number, variant, label, kind, edges, confidence: the fields of petition pages of either variant.

    words: doc_id, page_number, ord, word and edges; drawings: doc_id, page_number, ord and corners x0, y0, x1, y1; pages: doc_id, page_number, width, height.
    The variant picks the specifications; each looks for its anchor and takes the underline near it or a box beside it, a cell below it, the block up to the
    next heading, or a fixed place that nothing else has filled. Of fields with one label, kind and rounded box the first of the document stays.
    The pages' variants and the anchors are written tables, as most steps read them. A page without words is of the generic variant and has no fields; an empty table has none.
    """
    specs = spec_table(words.sparkSession)
    known = written(page_variants(words, pages), "petition-pages")
    found = find_anchors(words, known, specs).join(F.broadcast(specs.drop("terms", "variant")), "spec")
    under = drawings.where((F.abs(F.col("x1") - F.col("x0")) >= 70) & (F.abs(F.col("y1") - F.col("y0")) <= 3.5))
    place = Window.partitionBy(*_PAGE).orderBy("top", "left", "ord")
    rules = under.select(*_PAGE, "ord", F.col("x0").alias("left"), F.greatest(F.lit(0.0), F.col("y0") - 18).alias("top"), F.col("x1").alias("right"), (F.col("y0") + 6).alias("bottom")).withColumn("rule_id", F.row_number().over(place)).drop("ord")
    chosen = anchors.anchored_boxes(found.where("part in ('anchor', 'contact')").select(*_PAGE, "spec", "strategy", "min_width", "height", *_EDGES), rules, pages).join(F.broadcast(specs.select("spec", "part", "rank", "label", "kind", "confidence")), "spec")
    box = lambda left, top, right, bottom: [F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")).alias("b")]
    row = [*_PAGE, "rank", "label", "kind", "confidence"]
    c = F.col
    own = chosen.where("part = 'anchor'").select(*row, *box(*map(c, _EDGES)))
    split = c("left") + (c("right") - c("left")) * 0.46
    contact = chosen.where("part = 'contact'")
    phone = contact.select(*row, *box(c("left"), c("top"), F.greatest(c("left") + 70, split - 4), c("top") + 16))
    mail = contact.select(*_PAGE, (c("rank") + 1).alias("rank"), F.lit("e_posta").alias("label"), "kind", F.lit(0.88).alias("confidence"), *box(F.least(c("right") - 110, split + 4), c("top"), c("right"), c("top") + 16))
    sized = found.join(pages.select(*_PAGE, c("width").alias("page_width"), c("height").alias("page_height")), _PAGE)
    cells = sized.where("part = 'cell'").select(*row, *box(F.greatest(c("left") - 18, F.lit(0.0)), c("bottom") + 8, c("right") + 18, c("bottom") + 44))
    signs = sized.where("part = 'signature'").select(*row, *box(c("right") + 6, c("top") - 2, F.least(c("page_width") - 72, c("right") + 260), c("bottom") + 10))
    ends = found.where("part = 'end'").select(*_PAGE, "label", (c("top") - 12).alias("end"))
    blocks = sized.where("part = 'section'").join(ends, [*_PAGE, "label"], "left").withColumn("end", F.coalesce("end", F.least(c("page_height") - 40, c("bottom") + 180)))
    blocks = blocks.where(c("end") - (c("bottom") + 12) >= 40).select(*row, *box(F.lit(70.0), c("bottom") + 12, c("page_width") - 70, c("end")))
    free = own.unionByName(phone).unionByName(mail)
    places = F.array(*[F.struct(F.lit(len(SPECS) + 1 + i).alias("rank"), F.lit(x[0]).alias("label"), F.lit(x[1]).alias("kind"), *[F.lit(v).alias(e) for v, e in zip(x[2:], _EDGES, strict=True)]) for i, x in enumerate(FIXED)])
    single = known.where(c("variant") == SINGLE).join(words.select(*_PAGE).distinct(), _PAGE, "left_semi")
    fixed = single.select("*", F.inline(places)).where((c("top") < c("height")) & (c("left") < c("width"))).join(free.select(*_PAGE, "label").distinct(), [*_PAGE, "label"], "left_anti")
    fixed = fixed.select(*_PAGE, "rank", "label", "kind", F.lit(0.90).alias("confidence"), *box(c("left"), c("top"), F.least(c("width") - 4, c("right")), F.least(c("height") - 4, c("bottom"))))
    every = free
    for more in (cells, blocks, signs, fixed):
        every = every.unionByName(more)
    rounded = [F.bround(f"b.{x}", 0).alias(f"_{x}") for x in _EDGES]
    first = dedup.keep_first(every.select("*", *rounded), ["doc_id", "label", "kind", *(f"_{x}" for x in _EDGES)], ["page_number", "rank"])
    order = Window.partitionBy("doc_id").orderBy("page_number", "rank")
    return first.withColumn("ord", F.row_number().over(order)).join(known.select(*_PAGE, "variant"), _PAGE).select("doc_id", "ord", "page_number", "variant", "label", "kind", *[f"b.{x}" for x in _EDGES], "confidence")
