import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from leafline.functions import similarity
from leafline.operators import anchors, catalog, crops, layout, repair, retry
from leafline.sources import manifests, tables

VALUES = "doc_id string, ord int, source_key string, value string, confidence double, source_kind string, review_reasons array<string>"


def test_families(spark):
    rows = [("a", "driver_s_license_no_selected", "yes", 0.7), ("a", "passport_no_selected", "no", 0.6), ("a", "other_selected", "", 0.5), ("a", "driver_s_license_no", "D-77", 0.9), ("a", "passport_no", "N8830142 (NY)", 0.8), ("a", "other", "Other:", 0.8),
            ("b", "was_anyone_injured_yes", "yes", 0.61), ("b", "was_anyone_injured_no", "yes", 0.92), ("b", "if_yes_describe_the_injuries", "a broken arm", 0.8),
            ("c", "time_am", "", 0.0), ("c", "time_pm", None, 0.0), ("d", "other", "kept without its option", 0.4), ("e", "passport_no_selected", "x", 0.5), ("e", "passport_no_selected", "yes", 0.4), ("e", "passport_no", "passport no", 0.3)]
    got = {}
    for r in repair.repair(spark.createDataFrame([(d, i, k, v, c, "llm_page", []) for i, (d, k, v, c) in enumerate(rows)], VALUES)).orderBy("ord").collect():
        got.setdefault((r.doc_id, r.source_key), (r.value, r.confidence, r.source_kind, sorted(r.review_reasons)))
    assert got["a", "passport_no"][0] == got["a", "other"][0] == "" and got["a", "passport_no"][2:] == ("rule_family", ["expected_empty"])
    assert got["a", "driver_s_license_no_selected"] == ("yes", 0.5, "rule_family", []) and got["a", "driver_s_license_no"][:2] == ("D-77", 0.7)
    assert got["b", "was_anyone_injured_yes"][0] == "" and got["b", "was_anyone_injured_no"] == ("yes", 0.61, "rule_family", ["field_family_conflict"])
    assert got["b", "if_yes_describe_the_injuries"][0] == "" and got["b", "if_yes_describe_the_injuries"][3] == ["expected_empty"]
    assert got["c", "time_am"][0] == got["c", "time_pm"][0] == "" and got["d", "other"][0] == "kept without its option"
    # the first field of a repeated key decides; without a selected option all values go
    assert got["e", "passport_no_selected"][0] == "" and got["e", "passport_no"][0] == ""


def test_linked_fields(spark):
    words = ["Name", "of", "owner", "Ada", "Lovelace", "yes"]
    row = ("s", words, [0, 2, 2, 3, 3, 3], [[0, 1, 2], [3, 4], [5]], [[0, 1], [2, 0]], [[0, 0, 10, 5], [11, 0, 20, 5], [21, 1, 30, 6], [40, 0, 50, 5], [51, 0, 70, 7], [80, 2, 85, 9]])
    frame = spark.createDataFrame([row, ("t", [], [], [], [], [])], "sample_id string, words array<string>, labels array<int>, grouped_words array<array<int>>, linked_groups array<array<int>>, bboxes array<array<double>>".replace("array<array<double>>", "array<array<int>>"))
    got = manifests.linked_fields(frame).collect()
    assert [(r.sample_id, r.key, r.value, r.kind, tuple(r.box)) for r in got] == [("s", "Name of owner", "Ada Lovelace\nyes", "multiline", (40.0, 0.0, 85.0, 9.0))]
    assert [r.box for r in manifests.linked_fields(frame.drop("bboxes")).collect()] == [None]


def test_second_readings(spark):
    rows = [("d", "Phone", 0, "555-123-4567"), ("d", "Mailing address", 1, "12 Main"), ("d", "Type", 2, "cash x card other check"), ("d", "Start date", 3, "06/15/98"), ("d", "Termination Date", 4, "07/01/98"),
            ("d", "Supplier", 5, "M/A/R/C"), ("d", "Notes", 6, ""), ("d", "Police Station", 7, "ps 12"), ("d", "Year", 8, "19"), ("e", "Start date", 0, "06/15/98"), ("e", "Notes", 1, None)]
    current = spark.createDataFrame([(d, k, o, v, "llm_page", ["missing_value"]) for d, k, o, v in rows], "doc_id string, key string, ord int, value string, source_kind string, review_reasons array<string>")
    again = [("d", "Phone", "contact", "555-123-4567\n555-999-0000"), ("d", "Mailing address", "address", "12 Main Street, Springfield"), ("d", "Type", "choice", "card"), ("d", "Start date", "date", "08/15/98"), ("d", "Termination Date", "status", "Permanent"),
             ("d", "Supplier", "code", "WWA/R/C"), ("d", "Notes", "empty", "Notes"), ("d", "Police Station", "precision", "P.S. North Airport no. 12"), ("d", "Year", "precision", "FIR 2019"), ("e", "Start date", "date", "08/15/98"), ("e", "Notes", "empty", "seen"), ("z", "Phone", "contact", "1")]
    got = {(r.doc_id, r.key): r for r in retry.replaced(current, spark.createDataFrame(again, "doc_id string, key string, class string, value string")).collect()}
    value = lambda *k: got[k].value
    assert len(got) == len(rows) and value("d", "Phone").endswith("0000") and got["d", "Phone"].source_kind == "llm_retry_contact" and got["d", "Phone"].review_reasons == []
    assert value("d", "Mailing address") == "12 Main Street, Springfield" and value("d", "Type") == "card"
    assert value("d", "Start date") == "08/15/98" and got["d", "Start date"].review_reasons == ["ambiguous_date_family"]
    assert value("d", "Termination Date") == "Permanent" and value("d", "Supplier") == "WWA/R/C"
    assert value("d", "Notes") == "" and got["d", "Notes"].review_reasons == ["missing_value"]  # its own label
    assert value("d", "Police Station") == "North Airport" and value("d", "Year") == "2019"
    assert value("e", "Start date") == "06/15/98" and value("e", "Notes") == "seen"  # one date only
    assert retry.replaced(current.limit(0), spark.createDataFrame(again, "doc_id string, key string, class string, value string")).count() == 0


def test_contact_lines_and_seeds(spark):
    text = "Phone: 555-1 ; Fax: 7\nnothing\nTel.: x\nE-mail: a@b.c\nPhone: 555-1\nphone: 555-2,"
    got = {r.label: r.value for r in retry.contact_lines(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")).collect()}
    assert got == {"phone": "555-1\n555-2", "fax": "7", "email": "a@b.c"}
    payload = spark.createDataFrame([("d", "a", "1", "page", []), ("d", "x", "", "page", None)], "doc_id string, key string, value string, source_kind string, review_reasons array<string>")
    seeds = {r.key: (r.ord, r.value, r.review_reasons) for r in retry.seeded(payload, spark.createDataFrame([("d", "a", 0), ("d", "b", 1)], "doc_id string, key string, ord int")).collect()}
    assert seeds == {"a": (0, "1", []), "b": (1, "", ["missing_value"]), "x": (None, "", [])}


def test_lists_of_a_document(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(catalog.checkbox_choice(F.lit("time_am"), F.lit("maybe"))) is None and one(catalog.checkbox_choice(F.lit("passport_no_selected"), F.lit("Passport"))) is True
    assert one(catalog.word_growth(F.lit("a b"), F.lit("B c d c"))) == 2
    names = ["ogrenci_no", "Telefon", "gano", "ad_soyad__body"]
    fields = spark.createDataFrame([("p", n, "") for n in names] + [("q", n, None) for n in names[:3]], "doc_id string, name string, label string")
    assert {(r.doc_id, r.profile) for r in catalog.inferred_profile(fields).collect()} == {("p", "student_petition_tr"), ("q", "generic_printed_form")}
    aliases = spark.createDataFrame([("phone", "telefon")], "alias string, canonical string")
    renamed = fields.withColumn("name", F.when(F.col("name") == "Telefon", "Phone").otherwise(F.col("name")))
    assert {r.profile for r in catalog.inferred_profile(renamed, aliases).where("doc_id = 'p'").collect()} == {"student_petition_tr"}
    lone = spark.createDataFrame([("d", 0, "a", (1, 0.0, 0.0, 10.0, 20.0)), ("e", 0, "b", None)], "doc_id string, ord int, name string, box struct<page_number:int,left:double,top:double,right:double,bottom:double>")
    assert {(r.doc_id, r.geometry_score) for r in layout.geometry_score(lone).collect()} == {("d", 0.72), ("e", 0.0)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    try:
        tables.shared_dir(Session())
    except RuntimeError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a local folder on a cluster")


def test_anchor_phrases_take_the_closest_phrase(spark):
    page = "Tarih : Ogrenci N0 12 ad ve soyadi Ogrenci No ad soyad".split()
    words = spark.createDataFrame([("d", 1, i, w, 10.0 * i, 5.0, 10.0 * i + 8, 15.0 + i) for i, w in enumerate(page)] + [("e", 1, 0, "x", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_number int, ord int, word string, left double, top double, right double, bottom double")
    terms = [("number", "Öğrenci No"), ("name", "Adı Soyadı"), ("name", "ad soyad"), ("none", "")]
    plain = lambda s: s.lower().replace(":", "").strip()

    def best(asked):
        found = (0.0, None)
        for term in asked:
            n = len(term.split())
            for i in range(len(page) - n + 1):
                score = SequenceMatcher(None, plain(" ".join(page[i : i + n])), term).ratio()
                if score >= 0.72 and score > found[0]:
                    found = (score, (10.0 * i, 5.0, 10.0 * (i + n - 1) + 8, 15.0 + i + n - 1))
        return found

    got = {(r.doc_id, r.spec): (r.score, (r.left, r.top, r.right, r.bottom)) for r in anchors.anchor_phrases(words, terms).collect()}
    assert got == {("d", "number"): best(["ogrenci no"]), ("d", "name"): best(["adi soyadi", "ad soyad"])}


def test_merged_parts(spark):
    cases = [
        (["the car hit the wall", "car hit the wall"], "the car hit the wall"),
        (["hit the wall", "the car hit the wall\nat noon"], "the car hit the wall\nat noon"),
        (["he saw the red car stop", "the red car stop at noon\nRob Chen 518-555-1112"], "he saw the red car stop at noon\nRob Chen 518-555-1112"),
        (["alpha beta gamma", "zzz 11 qqq"], "alpha beta gamma"),  # unrelated
        (["a first line\n\na second line", None, "", "A first line!\na third line"], "a first line\na second line\na third line"),
        ([], ""),
    ]
    frame = spark.createDataFrame([(k, parts) for k, (parts, _) in enumerate(cases)], "k int, parts array<string>")
    got = {r.k: r.t for r in frame.select("k", crops.merged_parts(F.col("parts")).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def _plain(s):
    return " ".join(re.findall("[a-z]+|[0-9]+", s.lower()))


def _merged(parts):
    """The rule of merging, over lists of lines."""
    have = []
    signals = lambda x: x.count("@") + len(re.findall(r"\+?\d[\d()\-\s]{6,}\d", x))

    def overlap(a, b):
        a, b = _plain(a).split(), _plain(b).split()
        return max((k for k in range(3, 9) if k <= min(len(a), len(b)) and a[-k:] == b[:k]), default=0)

    for part in parts:
        new = [x.strip() for x in (part or "").splitlines() if x.strip()]
        old_text, new_text = _plain(" ".join(have)), _plain(" ".join(new))
        if not have or (new_text and new_text not in old_text and old_text in new_text):
            have = new if new else have
        elif new_text and new_text not in old_text:
            if k := overlap(have[-1], new[0]):
                have[-1] = " ".join(have[-1].split() + new.pop(0).split()[k:])
            for x in new:
                like = SequenceMatcher(None, _plain(have[-1]), _plain(x)).ratio() if _plain(have[-1]) and _plain(x) else 0.0
                if _plain(x) and _plain(x) not in map(_plain, have) and (signals(x) > signals(have[-1]) or overlap(have[-1], x) or like >= 0.28):
                    have.append(x)
    return "\n".join(have)


def test_merged_parts_of_random_texts(spark):
    r = random.Random(7)
    words = "the car hit wall at noon he saw red stop a@b.c 555-123-4567 zzz 11 qqq, It. seen".split()
    line = lambda: " ".join(r.choices(words, k=r.randint(0, 9)))
    rows = []
    for k in range(250):
        parts = ["\n".join(line() for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 3))]
        if parts and r.random() < 0.6:  # goes on where the first part ends
            parts.append(" ".join(parts[0].split()[-r.randint(1, 9) :]) + r.choice(["", " and on", "\n"]) + line())
        rows.append((k, parts))
    got = {x.k: x.t for x in spark.createDataFrame(rows, "k int, parts array<string>").select("k", crops.merged_parts(F.col("parts")).alias("t")).collect()}
    assert got == {k: _merged(parts) for k, parts in rows}
    assert sum("\n" in t for t in got.values()) > 20


def test_shared_letters_are_those_of_matching_blocks(spark):
    r = random.Random(2)
    rows = []
    for k in range(120):
        n, letters = r.choice([3, 10, 60, 260]), r.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz 0123456789"])
        a = "".join(r.choices(letters, k=r.randint(0, n)))
        b = list(a if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(0, n))))
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.choice(letters))
        rows.append((k, a, "".join(b)))
    got = {x.k: x.m for x in spark.createDataFrame(rows, "k int, a string, b string").select("k", similarity.shared_letters(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for k, a, b in rows}


def test_long_texts_read_in_parts(spark):
    rows = [("a", "describe", "he saw the red car stop", 0.9, "llm_page", ["missing_value"]), ("b", "contact info", "", 0.0, "llm_page", []), ("c", "describe", "short", 0.9, "llm_page", []), ("d", "name", "x\ny", 0.9, "llm_page", [])]
    current = spark.createDataFrame([(d, k, v + ("\n" if d == "a" else ""), c, s, x) for d, k, v, c, s, x in rows], "doc_id string, key string, value string, confidence double, source_kind string, review_reasons array<string>")
    boxes = [(d, f"{k}__body_{i}" if i else k, k, "text", True) for d, k in (("a", "describe"), ("b", "contact info"), ("c", "describe"), ("d", "name"), ("e", "contact info")) for i in range(4)]
    segments = spark.createDataFrame(boxes + [("a", "describe__body_9", "describe", "checkbox", True)], "doc_id string, name string, label string, kind string, has_box boolean")
    read = [("a", 1, "never read"), ("a", 2, "the red car stop at noon"), ("a", 3, "Rob Chen 518-555-1112"), ("b", 2, "Rob"), ("b", 3, "a@b.c 555-123-4567"), ("c", 3, "short and long and longer again"), ("d", 3, "z"), ("e", 2, "Al 555-123-4567"), ("e", 3, " ")]
    readings = spark.createDataFrame([(d, f"{dict(a='describe', b='contact info', c='describe', d='name', e='contact info')[d]}__body_{i}", v, d == "a") for d, i, v in read], "doc_id string, name string, value string, hinted boolean")
    got = {(r.doc_id, r.key): r for r in crops.long_refined(current, segments, readings).collect()}
    assert set(got) == {("a", "describe"), ("b", "contact info"), ("c", "describe"), ("d", "name")}  # one reading of an empty text is too few
    assert got["a", "describe"][2:] == ("he saw the red car stop at noon\nRob Chen 518-555-1112", 0.54, "llm_crop_ocr_hint", ["ocr_confusion_risk"])
    assert got["b", "contact info"].value == "Rob\na@b.c 555-123-4567" and got["b", "contact info"].source_kind == "llm_crop"
    assert got["c", "describe"].value == "short" and got["d", "name"].value == "x\ny"
    assert crops.long_refined(current.limit(0), segments, readings.limit(0)).count() == 0


def test_crops_of_names_and_stations(spark):
    rows = [("complainant name", "Rob Chen SI of Police", "Rob Chen", True), ("complainant name", "Mr Chen", "Robert Chen", True), ("complainant name", "Rob Chen", "Keisha Long", False), ("complainant name", "Rob", "Rob 2 Chen", False),
            ("police station", "station 12", "North Airport", True), ("police station", "North Airport", "12", False), ("police station", "", "x", True), ("statutes", "34", "34/107", True), ("termination date", "x", None, False), ("note", "a", "b", False)]
    frame = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, label string, v string, c string")
    got = {r.i: r.b for r in frame.select("i", crops.better(F.col("label"), F.col("v"), F.col("c")).alias("b")).collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}


def test_families_read_their_fields_once(spark):
    """One sort by family, also with repeated keys, null confidences and fields of no family."""
    rows = spark.createDataFrame(
        [("d", 0, "time am", "yes", 0.4), ("d", 1, "time am", "off", 0.9), ("d", 2, "time pm", "x", None), ("d", 3, "other", "Other", 0.7), ("d", 4, "year", "yes", 0.2), ("d", 5, "other selected", "on", 0.3), ("e", 0, "passport no", "A1", 0.5)],
        "doc_id string, ord int, nk string, value string, confidence double",
    ).withColumns({"source_kind": F.lit("page"), "review_reasons": F.array(F.lit("missing_value"))})
    out = repair._families(rows)
    got = {(r.doc_id, r.ord): (r.value, r.confidence, r.source_kind, ",".join(r.review_reasons)) for r in out.collect()}
    assert got == {
        ("d", 0): ("yes", 0.4, "rule_family", ""), ("d", 1): ("off", 0.9, "page", "missing_value"), ("d", 2): ("", 0.4, "rule_family", "expected_empty"), ("d", 3): ("", 0.3, "rule_family", "missing_value"),
        ("d", 4): ("yes", 0.2, "page", "missing_value"), ("d", 5): ("yes", 0.3, "rule_family", ""), ("e", 0): ("A1", 0.5, "page", "missing_value"),
    }
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2  # once in the final plan and once in the first
