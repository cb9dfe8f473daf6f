from pyspark.sql import functions as F

from leafline.functions import confidence, geometry, similarity, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_normalize_text(spark):
    for raw, want in [("Öğrenci No:12", "ogrenci no 12"), ("½ straße ﬁn", "12 strae fin"), (None, ""), ("A1b2", "a 1 b 2"), ("  é—È ", "ee")]:
        assert one(spark, text.normalize_text(F.col("v")), v=raw) == want


def test_canonical_forms(spark):
    assert one(spark, text.canonical_year(F.col("v")), v="1911/18") == "2018"
    assert one(spark, text.canonical_year(F.col("v")), v="in the year 1998 or 2001") == "2001"
    assert one(spark, text.canonical_name(F.col("v")), v="Sahabuddin Mondal Sahabuddin Mondal") == "sahabuddin mondal"
    assert one(spark, text.canonical_name(F.col("v")), v="A Yilmaz, SI of Police") == "ayilmaz"
    assert one(spark, text.canonical_station(text.normalize_text(F.col("v"))), v="P.S. Airport Airport 12") == "airport"
    assert one(spark, text.checkbox_state(text.normalize_text(F.col("v"))), v="Checked") == "true"
    assert one(spark, text.logical_name(F.col("v")), v="note__body_2") == "note"
    assert one(spark, text.continuation_index(F.col("v")), v="note__body_2") == 2
    assert one(spark, text.continuation_index(F.col("v")), v="note") == 0
    assert one(spark, F.date_format(text.short_date(F.col("v")), "yyyy-MM-dd"), v="6/15/98") == "1998-06-15"
    assert one(spark, text.short_date(F.col("v")), v="13/45/98") is None
    assert one(spark, text.strip_label(F.col("v"), ("e-mail", "email")), v="E-mail: a@b.com") == "a@b.com"


def test_statutes(spark):
    for raw, want in [("341/325% 09/56/34", "341/325/307/506/34"), ("354A/2006", "354A/506 Ipc"), ("399/402 ACl", "399/402 Ipc")]:
        assert one(spark, similarity.repair_statutes(F.col("v")), v=raw) == want


def test_similarity_is_directional(spark):
    assert one(spark, similarity.text_similarity(F.col("a"), F.col("b")), a="tide", b="diet") == 0.25
    assert one(spark, similarity.text_similarity(F.col("a"), F.col("b")), a="diet", b="tide") == 0.5
    assert one(spark, similarity.text_similarity(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_confidence(spark):
    got = one(spark, confidence.derived(F.lit("llm_page"), F.col("v"), F.array(F.lit("ocr_confusion_risk"))), v="x")
    assert abs(got - 0.74) < 1e-9
    assert one(spark, confidence.bucket(F.col("v")), v=1.0) == "0.8-1.0"
    assert one(spark, confidence.bucket(F.col("v")), v=-1.0) == "0.0-0.2"
    assert abs(one(spark, confidence.blended(F.lit(0.0), F.col("v")), v=70.0) - 0.7) < 1e-9


def test_boxes(spark):
    box = lambda a, b, c, d: F.struct(F.lit(1).alias("page_number"), F.lit(a).alias("left"), F.lit(b).alias("top"), F.lit(c).alias("right"), F.lit(d).alias("bottom"))
    assert one(spark, geometry.iou(box(0.0, 0.0, 10.0, 10.0), box(5.0, 0.0, 15.0, 10.0)), v="") == 50 / 150
    assert one(spark, geometry.center_distance(box(0.0, 0.0, 3.0, 4.0), box(0.0, 0.0, 3.0, 4.0)), v="") == 0.0
