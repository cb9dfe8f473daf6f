"""Page detection: the greedy labels of a line against a plain loop, and single pages."""

import random

from pyspark.sql import functions as F

from leafline.operators import pages, petition

SPANS = "doc_id string, page_number int, line int, ord int, text string, font string, left double, top double, right double, bottom double"
DRAWN = "doc_id string, page_number int, ord int, x0 double, y0 double, x1 double, y1 double"


def greedy(labels, rules, controls):
    used, out = set(), []
    for _, right in labels:
        barrier = min((c for c in controls if c > right + 6), default=float("inf"))
        for k, (left, end) in enumerate(rules):
            if k in used or end <= right + 8 or left >= barrier:
                continue
            a, b = max(left, right + 4), min(end, barrier - 6)
            if b - a >= 22:
                used.add(k)
                out.append((a, b))
            break
    return sorted(used), out


def test_labels_take_rules_like_a_plain_loop(spark):
    r = random.Random(3)
    edge = lambda n, wide: sorted((float(x), float(x + r.randint(8, wide))) for x in r.sample(range(0, 400, 10), n))
    rows = [(k, edge(r.randint(0, 5), 40), edge(r.randint(0, 6), 120), sorted(float(r.randint(0, 500)) for _ in range(r.randint(0, 4)))) for k in range(300)]
    frame = spark.createDataFrame(
        [(k, [("x:", a, b) for a, b in labels], [(i + 1, a, 0.0, b, 1.0) for i, (a, b) in enumerate(rules)], ticks) for k, labels, rules, ticks in rows],
        "k int, labels array<struct<plain:string,left:double,right:double>>, rules array<struct<rule_id:int,left:double,top:double,right:double,bottom:double>>, ticks array<double>",
    )
    got = {x.k: (sorted(i - 1 for i in x.t.used), [(f.left, f.right) for f in x.t.found]) for x in frame.select("k", pages._taken_rules(F.col("labels"), F.col("rules"), F.col("ticks")).alias("t")).collect()}
    assert got == {k: greedy(labels, rules, ticks) for k, labels, rules, ticks in rows}


def test_a_page(spark):
    spans = [
        ("d", 1, 0, 0, "Report No.", None, 10.0, 0.0, 60.0, 10.0), ("d", 1, 0, 1, ", 20", "Arial", 100.0, 0.0, 110.0, 10.0), ("d", 1, 1, 0, None, "Arial", 0.0, 20.0, 5.0, 30.0),
        ("d", 1, 2, 0, "Hurt?", "Arial", 10.0, 60.0, 40.0, 70.0), ("d", 1, 3, 0, "", "Times New Roman", 20.0, 80.0, 28.0, 90.0), ("d", 1, 3, 1, "Yes", "Arial", 30.0, 80.0, 45.0, 90.0),
        ("d", 1, 4, 0, " ", "Times New Roman", 20.0, 200.0, 28.0, 210.0), ("d", 1, 4, 1, "No", "Arial", 30.0, 200.0, 45.0, 210.0), ("d", 1, 5, 0, "HEADING", "Arial", 0.0, 300.0, 90.0, 310.0), ("d", 1, 6, 0, "Describe:", "Arial", 0.0, 400.0, 40.0, 410.0),
        ("e", 2, 0, 0, None, None, 0.0, 0.0, 1.0, 1.0),
    ]
    drawn = [("d", 1, 0, 65.0, 12.0, 95.0, 12.0), ("d", 1, 1, 65.0, 12.0, 105.0, 12.0), ("d", 1, 2, 115.0, 12.0, 160.0, 12.0), ("d", 1, 3, 0.0, 300.0, 200.0, 314.0), ("d", 1, 4, 42.0, 412.0, 300.0, 412.0), ("d", 1, 5, 0.0, 440.0, 310.0, 440.0), ("d", 1, 6, 0.0, 460.0, 310.0, 460.0), ("d", 1, 7, 0.0, 480.0, 310.0, 480.0), ("d", 1, 8, None, None, None, None)]
    got = pages.detect_fields(spark.createDataFrame(spans, SPANS), spark.createDataFrame(drawn, DRAWN)).orderBy("doc_id", "ord").collect()
    assert [(x.label, x.kind) for x in got] == [("Report No", "text"), ("Report Year", "text"), ("Hurt Yes", "checkbox"), ("No Selected", "checkbox"), ("Describe", "multiline")]
    assert (got[0].left, got[0].right, got[1].confidence) == (65.0, 105.0, 0.66)
    assert tuple(got[4].continuation) == (0.0, 422.0, 310.0, 464.0)
    assert pages.detect_fields(spark.createDataFrame([], SPANS), spark.createDataFrame(drawn, DRAWN)).count() == 0


def test_petition_pages(spark):
    word = lambda d, p, i, w, x, y: (d, p, i, w, float(x), float(y), float(x + 40), float(y + 10))
    rows = [word("a", 1, 0, "Ogrenci", 30, 50), word("a", 1, 1, "N0", 80, 50), word("a", 1, 2, "GANO", 30, 100), word("a", 1, 3, None, 30, 120), word("a", 2, 0, "GANO", 30, 100)]
    rows += [word("b", 1, i, w, 30 + 45 * i, 20) for i, w in enumerate("Tek Ders Başvuru Formu".split())] + [word("b", 1, 9, "Tarih", 30, 300), word("b", 1, 10, "Tel", 30, 400), word("b", 1, 11, "No", 75, 400), word("b", 1, 12, "/", 120, 400), word("b", 1, 13, "E-posta", 165, 400)]
    words = spark.createDataFrame(rows, "doc_id string, page_number int, ord int, word string, left double, top double, right double, bottom double")
    drawn = spark.createDataFrame([("b", 1, 0, 210.0, 415.0, 510.0, 415.0), ("b", 1, 1, 210.0, 405.0, 260.0, 405.0)], DRAWN)
    sizes = spark.createDataFrame([("a", 1, 595.0, 842.0), ("a", 2, 595.0, 842.0), ("b", 1, 500.0, 400.0), ("c", 1, 595.0, 842.0)], "doc_id string, page_number int, width double, height double")
    got = {(x.doc_id, x.page_number, x.label): x for x in petition.detect_petition_fields(words, drawn, sizes).collect()}
    assert {k for k in got if k[0] == "a"} == {("a", 1, "ogrenci_no"), ("a", 1, "gano")}  # the misread label; the second page repeats the first
    assert (got["a", 1, "gano"].left, got["a", 1, "gano"].top) == (80.0, 98.0) and got["a", 1, "ogrenci_no"].top == 68.0
    own = {k[2] for k in got if k[0] == "b"}
    assert "tarih" not in own and {"telefon", "e_posta", "ders_kodu", "fakulte_birim"} <= own and "danisman_gorusu" not in own
    phone, mail = got["b", 1, "telefon"], got["b", 1, "e_posta"]
    assert (phone.left, phone.top, phone.right) == (210.0, 398.0, 210 + 300 * 0.46 - 4) and (mail.right, mail.confidence) == (510.0, 0.88)
    assert got["b", 1, "ders_notu"].right == 496.0 and petition.detect_petition_fields(words.limit(0), drawn, sizes).count() == 0


def test_printed_terms_are_parts_of_the_page_text(spark):
    """Terms begin within a word and end within one, the first place counts; a control character in a word parts nothing. The anchors come from one written table."""
    words = spark.createDataFrame(
        [("a", 1, i, w, 10.0 * i, 300.0 - 5 * i, 10.0 * i + 8, 310.0 - 5 * i) for i, w in enumerate(["x", "(AD", "Soyad:", "GA\x00NO", "xGANOx", "ad", "soyad", None, "Ders", "Kod", "Dersin", "Adı"])],
        "doc_id string, page_number int, ord int, word string, left double, top double, right double, bottom double",
    )
    pages = spark.createDataFrame([("a", 1, petition.GENERIC)], "doc_id string, page_number int, variant string")
    specs = petition.spec_table(spark)
    got = {r.spec.split("/")[-1]: (r.left, r.top, r.right, r.bottom) for r in petition.printed_anchors(words, pages, specs).collect()}
    assert got == {"ad_soyad": (10.0, 290.0, 28.0, 305.0), "gano": (40.0, 280.0, 48.0, 290.0), "ders_adi": (100.0, 245.0, 118.0, 260.0)}
    plan = petition.find_anchors(words, pages, specs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
