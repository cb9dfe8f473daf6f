"""Small cases of results, names, packs, runs and boxes: nulls, blanks, ties and the laws they keep."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafline.operators import matrix, naming, render, results
from leafline.sources import regions


def test_values_of_evidence(spark):
    rows = [("a", 0, " k ", "1", {"selected": 0.9}, [("", "raw")], None), ("a", 1, "x", None, None, None, "why"), ("a", 2, "k", "2", {"overall": None}, [], ""), ("a", 3, None, "z", None, None, None), ("b", 0, " ", "z", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, field_key string, resolved_value string, breakdown map<string,double>, candidates array<struct<value:string,raw_text:string>>, reason string")
    got = {(r.doc_id, r.source_key): tuple(r)[1:] for r in results.values_of_evidence(df).collect()}
    assert got == {("a", "k"): (0, "k", "2", 0.0, "2", "resolver_evidence"), ("a", "x"): (1, "x", "", 0.0, "", "why")}


def test_results_without_mappings_and_with_nulls(spark):
    values = spark.createDataFrame([("a", "k", None, None, None, None, None), ("b", "k", "v", 0.5, "v", "page", [])], "doc_id string, source_key string, value string, confidence double, raw_text string, source_kind string, review_reasons array<string>")
    mappings = spark.createDataFrame([("b", 0, "k", "t", 2.0, "mapped"), ("b", 1, "k", "u", -1.0, "mapped")], "doc_id string, ord int, source_key string, target_field string, confidence double, status string")
    got = {r.doc_id: r for r in results.extraction_results(values, mappings).collect()}
    assert (got["b"].n_mappings, got["b"].weak_mappings, got["b"].confidence, got["b"].issue) == (2, 1, 0.5, "data.mapping.review_required") and got["a"].n_values == 1 and got["a"].issue is None
    shapes = {r.doc_id: r.fields for r in results.extraction_payload(values, mappings).collect()}
    assert '"mapped_target":"u"' in shapes["b"] and '"value":null' in shapes["a"]
    assert results.extraction_results(values.limit(0), mappings.limit(0)).count() == 0


def test_runs_lose_nothing_but_white_space_and_separators(spark):
    r = random.Random(11)
    parts = ["a@b.co", "555-123-4567", "1.2.2024", "/", " / ", ";", "|", "\n", "\r\n", " ", "word", "Ö", "+90 (212) 555 11 22"]
    rows = [(k, w, "".join(r.choices(parts, k=r.randint(0, 7))) if k % 25 else None) for k in range(400) for w in ("compound_contact", "date_signature", "multiline", "inline")]
    got = spark.createDataFrame(rows, "k int, way string, v string").select("k", "way", "v", render.runs(F.col("way"), F.col("v")).alias("r")).collect()
    bare = lambda s: re.sub(r"[\s/;|]+", "", s or "")
    for x in got:
        assert bare("".join(t.text for t in x.r)) == bare(x.v), x
        assert all(t.text for t in x.r) and (x.r == []) == (not (x.v or "").strip())
        assert all(t.role == ("email" if "@" in t.text and re.search(r"[\w.]+@b\.co", t.text) else t.role) for t in x.r if x.way == "compound_contact")


@pytest.mark.parametrize(("pack", "asked", "most"), [("smoke", None, 5), ("tuning", 7, 7), ("custom", None, None), ("custom", 4, 4), ("none", None, None)])
def test_pack_subsets(spark, pack, asked, most):
    rows = [("fir", b, f"s{i:03d}") for i in range(40) for b in "abc"[i % 3 :][:1]] + [("unknown", "a", f"u{i}") for i in range(12)]
    got = matrix.pack_subset(spark.createDataFrame(rows, "dataset string, bucket string, sample_id string"), matrix.pack_limits(spark, pack, asked)).collect()
    turns = sorted(((sum(1 for _, c, t in rows[:40] if c == b and t < s), b, s) for _, b, s in rows[:40]))
    assert {x.sample_id for x in got if x.dataset == "fir"} == {s for *_, s in turns[:most]} and sum(x.dataset == "unknown" for x in got) == 12


def test_matrix_fails_with_one_gate(spark):
    rows = [("fir", 10, 9, 10, 9, True, 0.5, False), ("template_e2e", 0, 0, 0, 0, False, None, True)]
    df = spark.createDataFrame(rows, "dataset string, fields int, exact int, covered int, matched int, success boolean, confidence double, review boolean")
    got = {(x.dataset, x.metric): x.passed for x in matrix.validation_matrix(df, True).collect()}
    assert got["fir", None] is True and got["template_e2e", None] is False and got[None, None] is False and got["real_demo", None] is True
    assert {(x.dataset, x.metric): x.passed for x in matrix.validation_matrix(df.where("dataset = 'fir'"), False).collect()}[None, None] is False


def test_region_shapes(spark):
    items = ['{"bbox": [1, 2, 30, 40, 9]}', '{"polygon": [], "points": [[5, 6], [1, 2]]}', '{"polygon": null, "points": [[5.5, 6], [1, 2]]}', '{"x1": 1, "y1": 2, "x2": 3, "y2": 4}', '{"bbox": ["a", 1, 2, 3]}', '{"bbox": [9, 9, 9, 20]}', '{"bbox": [-5, -5, 500, 500]}', "7", "null", '"s"']
    rows = [(i, 1, f"[{x}]", 100, 200) for i, x in enumerate(items)] + [(50, 1, None, 1, 1), (51, 1, "{", 1, 1), (52, 1, "[]", 1, 1), (53, 1, '{"layout": [{"x1": 0, "y1": 0, "x2": 1, "y2": 1}], "boxes": []}', 5, 5)]
    got = {r.doc_id: (r.left, r.top, r.right, r.bottom) for r in regions.region_boxes(spark.createDataFrame(rows, "doc_id int, page_number int, payload string, width int, height int")).collect()}
    assert got == {0: (1, 2, 30, 40), 1: (1, 2, 5, 6), 2: (1, 2, 5.5, 6), 3: (1, 2, 3, 4), 6: (0, 0, 100, 200), 53: (0, 0, 1, 1)}


def test_names(spark):
    fields = spark.createDataFrame([("d", 0, "field_1", "Name"), ("d", 1, "name_2", "Name"), ("d", 2, "name", None), ("d", 3, None, None), ("e", 0, "total", "")], "doc_id string, ord int, name string, label string")
    got = {(r.doc_id, r.ord): (r.recommended_name, r.is_valid) for r in naming.name_reviews(fields).collect()}
    assert got == {("d", 0): ("name", False), ("d", 1): ("name_2", True), ("d", 2): ("name_3", False), ("d", 3): ("field", False), ("e", 0): ("total", True)}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(naming.display_label(F.lit("__body"))) == "Continued Field" and one(naming.display_label(F.lit("it's_1st_ö"))) == "It'S 1St Ö"
    assert one(naming.footnote_label(F.lit("a_b_c"))) == "A B" and one(naming.safe_folder(F.lit("//"))) == "sample" and one(naming.anchor_key(F.lit(None).cast("string"))) == ""
    assert tuple(one(naming.placeholder_kind(F.lit(None).cast("string")))) == ("unknown", "unknown", 0.0) and one(naming.is_ticked(F.lit(None).cast("string"))) is False


def test_results_are_dealt_to_all_partitions(spark):
    """The joined and the distinct rows come by the session's number of partitions, not merged by their compressed bytes."""
    values = spark.createDataFrame([("d", "k", "", 0.5, ["expected_empty"]), ("d", "l", "", 0.5, [])], "doc_id string, source_key string, value string, confidence double, review_reasons array<string>")
    mappings = spark.createDataFrame([("d", "k", "t", 0.1, "mapped"), ("d", "l", "u", 0.1, "needs_review")], "doc_id string, source_key string, target_field string, confidence double, status string")
    out = results.extraction_results(values, mappings)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 3
    assert out.select("n_values", "n_mappings", "weak_mappings", "review_items").first() == (2, 2, 1, 2)
