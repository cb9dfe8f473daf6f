"""Queries of the operators on fields, candidates, checkboxes and layouts over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import anchors, catalog, crops, dedup, families, identity, layout, render, repair, retry, review, verify
from ..operators.assign import filled_values as fill
from ..sources import manifests
from .queries import NORM


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _every(n: int, column: str = "o_orderkey"):
    return F.col(column) % n == 0


def _lines(spark, d) -> DataFrame:
    """One row a line number of an order."""
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("mode"), F.min("l_quantity").alias("quantity"))


_LINES = "ln AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_returnflag) AS mode, min(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"


# --- candidates and values ---------------------------------------------------


def evidence(spark, d):
    o = _t(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    values = o.select(F.col("k").alias("doc_id"), F.lit("status").alias("field_key"), F.when(_every(7), "").otherwise(F.col("o_orderstatus")).alias("value"), F.lit(0.8).alias("confidence"), F.lit("page").alias("source"))
    again = o.where(_every(2)).select(F.col("k").alias("doc_id"), F.lit("status").alias("field_key"), F.when(_every(6), "X").when(_every(4), " ").otherwise(F.col("o_orderstatus")).alias("value"), F.lit(0.6).alias("confidence"), F.lit("region").alias("source"))
    return families.gather_evidence(values, again).select("doc_id", F.size("candidates").alias("n"), "conflict", "unresolved")


def resolved_values(spark, d):
    o = _t(spark, d, "orders")
    key = F.lit("status").alias("field_key")
    current = o.where(~_every(3)).select(F.col("o_orderkey").alias("doc_id"), key, F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 10 / 10.0).alias("confidence"))
    given = o.where(~_every(5)).select(F.col("o_orderkey").alias("doc_id"), key, F.when(_every(7), "").otherwise("A").alias("value"), (F.col("o_orderkey") % 4 / 4.0).alias("confidence"))
    return families.resolve_values(current, given).select("doc_id", "value", F.round("confidence", 6).alias("confidence"))


def review_reasons(spark, d):
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    reasons = F.when(k % 4 == 0, F.array(F.lit("expected_empty"))).when(k % 4 == 1, F.array(F.lit("ocr_confusion_risk"), F.lit("missing_value"))).otherwise(F.array().cast("array<string>"))
    values = c.select(k.alias("doc_id"), F.lit("segment").alias("source_key"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"), reasons.alias("review_reasons"))
    mappings = c.select(k.alias("doc_id"), F.lit("segment").alias("source_key"), F.when(k % 5 == 0, "unmapped").otherwise("mapped").alias("status"))
    return review.review_items(values, mappings)


def filled_values(spark, d):
    lines = _lines(spark, d)
    values = lines.select("doc_id", F.col("n").alias("ord"), F.concat(F.lit("s"), F.col("n").cast("string")).alias("source_key"), F.col("mode").alias("value"), (F.col("quantity") / 100).cast("double").alias("confidence"))
    target = F.when(F.col("n") == 7, "").otherwise(F.concat(F.lit("t"), (F.col("n") % 3).cast("string")))
    mappings = lines.select("doc_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("source_key"), target.alias("target_field"), F.lit(0.5).alias("confidence"))
    return fill(values, mappings).select("doc_id", "target_field", "value", F.round("confidence", 6).alias("confidence"))


def second_readings(spark, d):
    """Which class of second reading replaces an order's value."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(
        k.alias("doc_id"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 5 == 2, "A-1.x").otherwise(F.col("o_orderpriority")).alias("value"),
        F.when(k % 7 == 0, " ").when(k % 7 == 1, F.date_format("o_orderdate", "dd.MM.yy")).when(k % 7 == 2, "B/22").when(k % 7 == 3, "12 Long Road, Some Town, Far").when(k % 7 == 4, "Permanent").otherwise(F.col("o_orderpriority")).alias("other"),
    )
    key = F.when(F.col("doc_id") % 2 == 0, "Termination Date").otherwise("Store address")
    out = o.withColumns({"key": key, "plain": F.lower(key)})
    taken = lambda name: retry.takes(name, F.col("key"), F.col("plain"), F.col("value"), F.col("other"), F.lit(False))
    return out.select("doc_id", *[taken(c).alias(c) for c in ("address", "date", "code", "empty", "status")], retry.key_in_class("date", F.col("key"), F.col("plain"), F.col("value")).alias("is_date"))


def station_scores(spark, d):
    s = _t(spark, d, "supplier")
    name = F.concat_ws(" ", F.lit("PS"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "North Airport").when(F.col("s_suppkey") % 3 == 1, "old x form").otherwise("abc"))
    return s.select("s_suppkey", retry.station_score(name).alias("score"))


def field_families(spark, d):
    """Two options of identification and the value of one, by order."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    field = lambda i, key, value, conf: F.struct(F.lit(i).alias("ord"), F.lit(key).alias("nk"), value.alias("value"), conf.cast("double").alias("confidence"))
    fields = F.array(
        field(0, "driver s license no selected", F.when(k % 2 == 0, "Yes").otherwise(""), k % 5 / 10.0),
        field(1, "passport no selected", F.when(k % 3 == 0, "x").when(k % 3 == 1, "checked").otherwise("off"), F.lit(0.25)),
        field(2, "passport no", F.when(k % 7 == 0, "Passport No:").otherwise(F.col("o_orderpriority")), F.lit(0.6)),
    )
    rows = o.select(k.alias("doc_id"), F.inline(fields)).withColumns({"source_kind": F.lit("llm_page"), "review_reasons": F.array(F.lit("missing_value"))})
    out = repair._families(rows)
    return out.select("doc_id", "ord", "value", F.round("confidence", 6).alias("confidence"), "source_kind", F.array_join("review_reasons", ",").alias("reasons"))


# --- lists of a document -------------------------------------------------------


def expected_keys(spark, d):
    n = F.col("n")
    name = F.when(n == 1, "year").when(n == 2, "note__body").when(n == 3, "note").when(n == 4, "statutes").when(n == 5, "note__body_2").otherwise(F.concat(F.lit("f"), n.cast("string")))
    fields = _lines(spark, d).select("doc_id", n.alias("ord"), name.alias("name"))
    return catalog.expected_keys(fields, spark.createDataFrame([("statutes", 1), ("year", 2)], "canonical string, priority int"))


def inferred_profile(spark, d):
    names = F.array(*map(F.lit, ("police_station", "Statutes", "complainant name", "ogrenci_no", "gano", "telefon", "ad_soyad")))
    fields = _lines(spark, d).where("n <= 7 and quantity < 40").select("doc_id", F.get(names, F.col("n").cast("int") - 1).alias("name"), F.lit("").alias("label"))
    return catalog.inferred_profile(fields)


def checkbox_groups(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "time_am").when(k % 4 == 1, "passport_no_selected").when(k % 4 == 2, "injured_yes").otherwise("note")
    value = F.when(k % 5 == 0, "").when(k % 5 == 1, "X").when(k % 5 == 2, "8 am").when(k % 5 == 3, "passport").otherwise("Off")
    return _t(spark, d, "part").select(k, catalog.checkbox_group(name).alias("grp"), catalog.checkbox_choice(name, value).alias("marked"))


def marked_option(spark, d):
    scores = _lines(spark, d).select("doc_id", F.lit("g").alias("grp"), F.col("n").cast("string").alias("key"), F.col("n").alias("ord"), (F.col("quantity") % 13 / 100).cast("double").alias("score"))
    return catalog.marked_option(scores).select("doc_id", "key")


def artifact_ids(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return catalog.artifact_ids(e).select("seq", "artifact_id")


def page_texts(spark, d):
    spans = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page_number"), F.col("turn").alias("ord"), "text")
    return catalog.page_texts(spans).select("doc_id", "page_number", F.md5("text").alias("text"))


def _case_results(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    checks = c.select(k.alias("case_id"), F.inline(F.array(
        F.struct(F.lit("Segment").alias("field"), F.col("c_mktsegment").alias("expected"), F.lit("value").alias("kind")),
        F.struct(F.lit("time_family").alias("field"), F.lit("time_am").alias("expected"), F.lit("family").alias("kind")),
    )))
    values = c.select(k.alias("case_id"), F.inline(F.array(
        F.struct(F.lit("Segment").alias("key"), F.when(k % 4 == 0, "").otherwise(F.lower("c_mktsegment")).alias("value")),
        F.struct(F.lit("time_am").alias("key"), F.when(k % 3 == 0, "yes").otherwise("no").alias("value")),
        F.struct(F.lit("time_pm").alias("key"), F.when(k % 2 == 0, "Yes").otherwise("").alias("value")),
    )))
    members = spark.createDataFrame([("time_family", "time_am", 0), ("time_family", "time_pm", 1)], "family string, member string, ord int")
    return catalog.case_checks(checks, values, members)


def case_checks(spark, d):
    return _case_results(spark, d).select("case_id", "field", "actual", "matched")


def case_report(spark, d):
    k = F.col("c_custkey")
    cases = _t(spark, d, "customer").select(k.alias("case_id"), (k % 10 / 10.0).cast("double").alias("confidence"), (k % 3 == 0).alias("passed"), (k % 8 == 0).alias("review_required"))
    got = catalog.case_report(_case_results(spark, d), cases)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


def overlapping_words(spark, d):
    k = F.col("p_partkey")
    left, right = F.concat("p_name", F.lit(" alpha beta gamma")), F.when(k % 3 == 0, F.concat(F.lit("Alpha beta gamma "), "p_name")).when(k % 3 == 1, F.lit("beta gamma x")).otherwise(F.concat("p_name", F.lit(" alpha beta gamma")))
    return _t(spark, d, "part").select(k, verify.overlap_words(left, right).alias("words"), catalog.word_growth(left, right).alias("growth"))


def document_profile(spark, d):
    k = F.col("p_partkey")
    p = _t(spark, d, "part").select(k, F.when(k % 3 == 0, "tr").when(k % 3 == 1, "en").otherwise("unknown").alias("language"), F.when(k % 4 == 0, "student_petition").when(k % 4 == 1, "insurance_incident").when(k % 4 == 2, "generic_form").otherwise("unknown").alias("family"), F.when(k % 5 == 0, "handwritten").otherwise("printed").alias("script"), identity.layout_style(k % 11, k % 7).alias("layout"))
    route = identity.reviewed_route(identity.route(F.when(k % 2 == 0, "flat").otherwise("acroform"), k % 3, k % 5), k % 13 == 0, k % 9 / 10.0)
    return p.select("p_partkey", "layout", identity.profile(F.col("language"), F.col("script"), F.col("family")).alias("profile"), F.round(identity.identity_confidence(F.col("language"), F.col("layout"), F.col("family")), 6).alias("confidence"), route.alias("route"))


def annotations(spark, d):
    k = F.col("p_partkey")
    box = F.array(*[x.cast("double") for x in (k * 37 % 500, k * 91 % 700, k % 90 + 1, k % 40 + 1)])
    rows = _t(spark, d, "part").select(F.concat(F.lit("img"), F.floor(k / 10).cast("string")).alias("image_name"), (k % 5).cast("int").alias("category_id"), box.alias("bbox"), F.when(k % 11 == 0, " ").otherwise(F.col("p_brand")).alias("text"))
    return manifests.annotation_fields(rows).select("sample_id", "key", "value", "box.left", "box.top", "box.right", "box.bottom")


# --- boxes -----------------------------------------------------------------------


def _fields(spark, d):
    """Boxes of parts, some without one."""
    k = F.col("p_partkey")
    left, top = (k * 37 % 500).cast("double"), (k * 91 % 700).cast("double")
    box = F.struct(F.lit(1).alias("page_number"), left.alias("left"), top.alias("top"), (left + 20 + k % 90).alias("right"), (top + 6 + k % 40).alias("bottom"))
    return _t(spark, d, "part").select(F.floor(k / 20).alias("doc_id"), k.alias("ord"), k.cast("string").alias("name"), F.when(k % 17 != 0, box).alias("box"))


_FIELDS = "b AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, p_partkey AS k, p_partkey % 17 = 0 AS bare, CAST(p_partkey * 37 % 500 AS DOUBLE) AS l, CAST(p_partkey * 91 % 700 AS DOUBLE) AS t, CAST(p_partkey * 37 % 500 + 20 + p_partkey % 90 AS DOUBLE) AS r, CAST(p_partkey * 91 % 700 + 6 + p_partkey % 40 AS DOUBLE) AS m FROM part)"
_PAIRS = """p AS (SELECT doc_id, x, y, i / (s - i) AS iou FROM (SELECT x.doc_id, x.k AS x, y.k AS y, greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.m, y.m) - greatest(x.t, y.t)) AS i, (x.r - x.l) * (x.m - x.t) + (y.r - y.l) * (y.m - y.t) AS s
FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.k < y.k WHERE NOT x.bare AND NOT y.bare))"""


def layout_codes(spark, d):
    return layout.layout_codes(_fields(spark, d))


def geometry_scores(spark, d):
    return layout.geometry_score(_fields(spark, d)).withColumn("geometry_score", F.round("geometry_score", 6))


def reading_order(spark, d):
    return layout.reading_order(_fields(spark, d)).select("doc_id", "name", "place")


def continuation_boxes(spark, d):
    tall = F.struct("box.page_number", "box.left", "box.top", "box.right", (F.col("box.bottom") + F.col("ord") % 60).alias("bottom"))
    rows = _fields(spark, d).withColumn("box", F.when(F.col("box").isNotNull(), tall))
    return layout.continuation_boxes(rows).select("name", "k", F.round("box.top", 6).alias("top"), F.round("box.bottom", 6).alias("bottom"))


def distinct_boxes(spark, d):
    k = F.col("p_partkey")
    left, top = k % 40 / 2.0, k % 6 / 2.0
    box = F.struct(F.lit(1).alias("page_number"), left.alias("left"), top.alias("top"), (left + 20).alias("right"), (top + 8).alias("bottom"))
    rows = _t(spark, d, "part").select((k % 3).alias("kind"), k.alias("ord"), box.alias("box"))
    return dedup.distinct_boxes(rows).select("kind", "ord")


def lines_and_rules(spark, d):
    k = F.col("p_partkey")
    edges = lambda left, top, w, h: [left.cast("double").alias("left"), top.cast("double").alias("top"), (left + w).cast("double").alias("right"), (top + h).cast("double").alias("bottom")]
    own = [F.floor(k / 20).alias("doc_id"), F.lit(1).alias("page_number")]
    lines = _t(spark, d, "part").select(*own, k.alias("line_id"), *edges(k * 37 % 500, k * 91 % 200, 60, 10))
    rules = _t(spark, d, "part").select(*own, k.alias("rule_id"), *edges(k * 53 % 600, k * 17 % 200, 80, 1))
    return layout.nearest_right(layout.candidates_on_lines(lines, rules)).select("line_id", "rule_id")


def _edges(left, top, w, h):
    return [left.cast("double").alias("left"), top.cast("double").alias("top"), (left + w).cast("double").alias("right"), (top + h).cast("double").alias("bottom")]


def heading_boxes(spark, d):
    k, p = F.col("p_partkey"), _t(spark, d, "part")
    own = [F.floor(k / 20).alias("doc_id"), F.lit(1).alias("page_number")]
    lines = p.select(*own, F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.upper("p_name"), F.lit(":"))).otherwise(F.col("p_name")).alias("text"), *_edges(k * 37 % 300, k * 91 % 400, 60, 10))
    boxes = p.select(*own, k.alias("box_id"), *_edges(k * 53 % 300, k * 17 % 400, 150, 90))
    return anchors.heading_boxes(boxes, lines).select("doc_id", "box_id")


def long_answers(spark, d):
    k, p = F.col("p_partkey"), _t(spark, d, "part")
    own = [F.floor(k / 20).alias("doc_id"), F.lit(1).alias("page_number")]
    fields = p.where(k % 2 == 0).select(*own, k.alias("field_id"), (k % 20).alias("ord"), F.when(k % 4 == 0, "Describe it").otherwise("Name").alias("label"), *_edges(k * 37 % 100 + 50, k * 91 % 300, 40, 10))
    rules = p.select(*own, k.alias("rule_id"), *_edges(k * 13 % 60, k * 17 % 360, 140, 1))
    lines = p.where(k % 5 == 0).select(*own, (k % 20).alias("ord"), F.when(k % 10 == 0, "").otherwise(F.col("p_name")).alias("text"), (k % 15 == 0).alias("ignorable"), *_edges(k * 7 % 90, k * 29 % 360, 40, 8))
    return anchors.continuations(fields, rules, lines)


def anchored_boxes(spark, d):
    k, p = F.col("p_partkey"), _t(spark, d, "part")
    own = [F.floor(k / 20).alias("doc_id"), F.lit(1).alias("page_number")]
    way = F.when(k % 3 == 0, "underline_right").when(k % 3 == 1, "underline_below").otherwise("underline_above")
    marks = p.where(k % 2 == 0).select(*own, k.cast("string").alias("spec"), way.alias("strategy"), (k % 50 + 30).cast("double").alias("min_width"), F.lit(14.0).alias("height"), *_edges(k * 37 % 500, k * 91 % 700, 60, 10))
    rules = p.select(*own, k.alias("rule_id"), *_edges(k * 53 % 500, k * 17 % 700, 20 + k % 80, 1))
    pages = p.select(*own, F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()
    return anchors.anchored_boxes(marks, rules, pages)


def _plan(spark, d):
    f = _fields(spark, d)
    k = F.col("ord")
    names = F.array(*map(F.lit, ("ad_soyad", "telefon", "akts", "witness_note", "birth_date", "policy", "danisman_gorusu")))
    name = F.concat(F.get(names, (k % 7).cast("int")), F.when(k % 20 == 6, "").otherwise(F.concat(F.lit("_"), k.cast("string"))))
    kind = F.when(k % 11 == 0, "multiline").when(k % 13 == 0, "signature").otherwise("text")
    profile = F.when(F.col("doc_id") % 2 == 0, "student_petition_tr").otherwise("generic_printed_form")
    fields = f.select("doc_id", profile.alias("profile"), name.alias("name"), kind.alias("kind"), "box")
    values = fields.select("doc_id", "name", F.concat(F.lit(" "), "kind").alias("value"))
    specs = spark.createDataFrame([("student_petition_tr", "danisman_gorusu", (164.0, 450.0, 433.0, 478.0), 9.2, 8.9, 0.8)], render.SPEC)
    return render.plan(fields, values, specs)


def render_plan(spark, d):
    r = lambda c: F.round(c, 6).alias(c.split(".")[-1])
    return _plan(spark, d).select("doc_id", "place", "name", "writer", "container", "value", r("target.left"), r("target.bottom"), r("font_size"), r("multiline_font_size"), r("baseline"), "anchor", F.array_join("warnings", ",").alias("warnings"))


def render_summary(spark, d):
    return render.plan_summary(_plan(spark, d))


def evidence_candidates(spark, d):
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    key = F.lit("status").alias("key")
    values = o.select(k.alias("doc_id"), key, F.col("o_orderstatus").alias("value"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("raw_text"), F.lit("llm_page").alias("source_kind"), (k % 10 / 10.0).alias("confidence"))
    readings = o.where(k % 2 == 0).select(k.alias("doc_id"), key, F.lit("F").alias("page_value"), F.when(k % 4 == 0, " O ").alias("page_precision_value"), F.lit("").alias("crop_value"), F.when(k % 5 == 0, "F").otherwise("Z").alias("crop_precision_value"))
    fields = o.where(k % 7 != 0).select(k.alias("doc_id"), key, F.lit("the_status").alias("name"), (k % 2 + 1).cast("int").alias("page_number"), F.lit(0).alias("ord"))
    pages = o.select(k.alias("doc_id"), F.lit(1).alias("page_number"), F.when(k % 9 == 0, " ").otherwise("text").alias("text"))
    found = families.evidence_candidates(values, readings, fields, pages)
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["value"], c["source"])), ",")
    return found.select("doc_id", "page_number", "anchor", listed.alias("candidates"), "reason")


def crop_policy(spark, d):
    """Which orders' values are read again, and whether the second reading is better."""
    k = F.col("o_orderkey")
    labels = F.array(*map(F.lit, ("order date", "year", "fax no", "store address", "supplier", "approval", "note")))
    o = _t(spark, d, "orders").select(
        k.alias("doc_id"), F.lit("v").alias("key"), F.get(labels, (k % 7).cast("int")).alias("label"), F.when(k % 13 == 0, "checkbox").otherwise("text").alias("kind"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 5 == 2, "A/1").otherwise(F.col("o_orderpriority")).alias("value"),
        F.lit(0.5).alias("confidence"), F.lit("llm_page").alias("source_kind"), F.array().cast("array<string>").alias("review_reasons"),
        F.when(k % 6 == 0, F.date_format("o_orderdate", "yyyy")).when(k % 6 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 6 == 2, "12 Long Road, Some Town").when(k % 6 == 3, "B-2").when(k % 6 == 4, " ").otherwise(F.col("o_orderpriority")).alias("other"),
    )
    again = o.where("doc_id % 11 <> 0").select("doc_id", "key", F.col("other").alias("value"), (F.col("doc_id") % 2 == 0).alias("hinted"))
    out = crops.refined(o.drop("other"), again)
    return out.select("doc_id", "value", F.round("confidence", 6).alias("confidence"), "source_kind", F.array_join("review_reasons", ",").alias("reasons"))


def long_readings(spark, d):
    c = _t(spark, d, "conversations")
    one, two = F.col("text"), F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit("\n555-123-4567 more")).otherwise(F.lit("")))
    label = F.when(F.col("conv_id") % 3 == 0, "describe it").when(F.col("conv_id") % 3 == 1, "contact info").otherwise("name")
    return c.select("conv_id", "turn", crops.long_asked(label, one).alias("asked"), crops.long_better(one, two).alias("better"), crops.long_better(two, one).alias("back"))


def long_texts(spark, d):
    """Descriptions of parts and orders whose last lines are read one by one and merged with what was read before."""
    k, p = F.col("p_partkey"), _t(spark, d, "part")
    name = F.concat("p_name", F.lit(" of "), "p_type", F.lit(" sort"))
    tail = F.expr("substring_index(concat(p_name, ' of ', p_type, ' sort'), ' ', -3)")
    rows = p.select(k.alias("doc_id"), F.lit("describe_it").alias("key"), F.when(k % 6 == 4, "").otherwise(F.concat(name, F.lit("\n"))).alias("value"), F.lit(0.5).alias("confidence"), F.lit("llm_page").alias("source_kind"), F.array().cast("array<string>").alias("review_reasons"))
    part = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    part = part.withColumn("name", F.when(F.col("i") == 0, "describe_it").otherwise(F.concat(F.lit("describe_it__body_"), F.col("i").cast("string"))))
    segments = part.select(k.alias("doc_id"), "name", F.lit("Describe it").alias("label"), F.lit("text").alias("kind"), (k % 7 > 0).alias("has_box"))
    one = F.when(k % 6 == 0, name).when(k % 6 == 1, F.concat(F.lit("A "), name, F.lit("\nno "), k.cast("string"))).when(k % 6 == 2, F.concat(tail, F.lit(" no. "), k.cast("string"))).otherwise(F.lit("0 0"))
    two = F.when(k % 6 == 2, F.lit("call 555-123-4567")).when(k % 6 == 5, F.lit("mail a@b.org")).otherwise(F.lit(" "))
    read = part.where("i > 0").select(k.alias("doc_id"), "name", F.when(F.col("i") == 1, "too early").when(F.col("i") == 2, one).otherwise(two).alias("value"), (k % 4 == 0).alias("hinted"))
    out = crops.long_refined(rows, segments, read)
    return out.select("doc_id", "value", F.round("confidence", 6).alias("confidence"), "source_kind", F.array_join("review_reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (
    evidence, resolved_values, review_reasons, filled_values, second_readings, station_scores, field_families, expected_keys, inferred_profile, checkbox_groups, marked_option,
    artifact_ids, page_texts, case_checks, case_report, overlapping_words, document_profile, annotations, layout_codes, geometry_scores, reading_order, continuation_boxes,
    distinct_boxes, lines_and_rules, heading_boxes, long_answers, anchored_boxes, render_plan, render_summary, evidence_candidates,
    crop_policy, long_readings, long_texts,
)}

_DATE = r"(^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$|^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}$)"
_CASE_ROWS = """x AS (SELECT c_custkey AS case_id, 'Segment' AS field, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS actual, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END = lower(c_mktsegment) AS matched FROM customer
UNION ALL SELECT c_custkey, 'time_family', CASE WHEN c_custkey % 3 = 0 THEN 'time_am' WHEN c_custkey % 2 = 0 THEN 'time_pm' ELSE '' END, c_custkey % 3 = 0 FROM customer)"""

SQL = {
    "evidence": """WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS v, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'X' WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END ELSE '' END AS r FROM orders)
SELECT k AS doc_id, CAST(1 + CAST(r <> '' AS INTEGER) AS INTEGER) AS n, v <> '' AND r <> '' AND v <> r AS conflict, v = '' AS unresolved FROM j""",
    "resolved_values": """WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderkey % 10 / 10.0::DOUBLE AS c FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'A' END AS v, o_orderkey % 4 / 4.0::DOUBLE AS c FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(c.k, a.k) AS doc_id, CASE WHEN a.k IS NOT NULL AND (c.k IS NULL OR (a.v <> '' AND a.c >= c.c)) THEN a.v ELSE c.v END AS value, round(CASE WHEN a.k IS NOT NULL AND (c.k IS NULL OR (a.v <> '' AND a.c >= c.c)) THEN a.c ELSE c.c END, 6) AS confidence FROM c FULL JOIN a ON c.k = a.k""",
    "review_reasons": """SELECT DISTINCT doc_id, 'segment' AS key, reason FROM (
SELECT c_custkey AS doc_id, unnest(['ocr_confusion_risk', 'missing_value']) AS reason FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'missing_value' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, 'low_mapping_confidence' FROM customer WHERE c_custkey % 5 = 0)""",
    "filled_values": f"WITH {_LINES}, r AS (SELECT *, 't' || (n % 3) AS target_field, row_number() OVER (PARTITION BY doc_id, n % 3 ORDER BY n DESC) AS rn FROM ln WHERE n <> 7) SELECT doc_id, target_field, mode AS value, round((CAST(quantity / 100 AS DOUBLE) + 0.5) / 2, 6) AS confidence FROM r WHERE rn = 1",
    "second_readings": rf"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS due, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 5 = 2 THEN 'A-1.x' ELSE o_orderpriority END AS v,
CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%d.%m.%y') WHEN o_orderkey % 7 = 2 THEN 'B/22' WHEN o_orderkey % 7 = 3 THEN '12 Long Road, Some Town, Far' WHEN o_orderkey % 7 = 4 THEN 'Permanent' ELSE o_orderpriority END AS c FROM orders),
p AS (SELECT *, {NORM.format('v')} AS nv, {NORM.format('c')} AS nc, trim(c) <> '' AS has, regexp_matches(v, '{_DATE}') AS dv, regexp_matches(c, '{_DATE}') AS dc FROM o)
SELECT k AS doc_id, has AND (v = '' OR len(string_split(trim(c), ' ')) >= len(string_split(trim(v), ' ')) + 2 OR length(c) >= length(v) + 12 OR length(c) - length(replace(c, ',', '')) > length(v) - length(replace(v, ',', ''))) AS address,
has AND CASE WHEN v = '' THEN nc <> '' ELSE nc <> nv AND ((due AND NOT dc) OR (dv AND dc)) END AS date,
has AND nc <> nv AND NOT dc AND length(c) <= 16 AND regexp_matches(c, '^[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)+\.?$') AS code, has AND v = '' AND nc <> '' AS "empty", has AND ((due AND nc = 'permanent') OR (v = '' AND NOT dc)) AS status, due OR dv AS is_date FROM p""",
    "station_scores": f"""WITH w AS (SELECT s_suppkey, {NORM.format("'PS ' || s_name || ' ' || CASE s_suppkey % 3 WHEN 0 THEN 'North Airport' WHEN 1 THEN 'old x form' ELSE 'abc' END")} AS p FROM supplier)
SELECT s_suppkey, CAST(list_sum(list_transform(string_split(p, ' '), lambda t: CASE WHEN list_contains({list(retry.STATION_NOISE)!r}, t) THEN -2 ELSE 0 END + CASE WHEN length(t) = 1 THEN -2 ELSE 0 END + CASE WHEN regexp_full_match(t, '[0-9]+') THEN -2 ELSE 0 END
+ CASE WHEN list_contains({list(retry.STATION_NOISE)!r}, t) OR NOT regexp_full_match(t, '[a-z]+') THEN 0 WHEN length(t) >= 4 THEN 2 WHEN length(t) = 3 THEN 1 ELSE 0 END)) + CASE WHEN contains(p, 'airport') THEN 2 ELSE 0 END AS INTEGER) AS score FROM w""",
    "field_families": """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS pr, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 1 AS b, o_orderkey % 5 / 10.0::DOUBLE AS ca, o_orderkey % 7 = 0 AS noise FROM orders),
w AS (SELECT *, CASE WHEN a AND b THEN CASE WHEN 0.25 > ca THEN 2 ELSE 1 END WHEN a THEN 1 WHEN b THEN 2 ELSE 0 END AS win, a AND b AS both_, CASE WHEN ca > 0 THEN least(ca, 0.25::DOUBLE) ELSE 0.25::DOUBLE END AS low FROM o)
SELECT k AS doc_id, 0 AS ord, CASE WHEN win = 1 THEN 'yes' ELSE '' END AS value, round(low, 6) AS confidence, 'rule_family' AS source_kind, CASE WHEN win <> 1 THEN 'expected_empty' WHEN both_ THEN 'field_family_conflict' ELSE '' END AS reasons FROM w
UNION ALL SELECT k, 1, CASE WHEN win = 2 THEN 'yes' ELSE '' END, round(low, 6), 'rule_family', CASE WHEN win <> 2 THEN 'expected_empty' WHEN both_ THEN 'field_family_conflict' ELSE '' END FROM w
UNION ALL SELECT k, 2, CASE WHEN win <> 2 OR noise THEN '' ELSE pr END, CASE WHEN win = 2 AND both_ AND NOT noise THEN round(low, 6) ELSE 0.25 END, 'rule_family', CASE WHEN win <> 2 THEN 'expected_empty' WHEN both_ AND NOT noise THEN 'missing_value,field_family_conflict' ELSE 'missing_value' END FROM w""",
    "expected_keys": f"""WITH {_LINES}, k AS (SELECT doc_id, CASE WHEN n = 1 THEN 'year' WHEN n IN (2, 3, 5) THEN 'note' WHEN n = 4 THEN 'statutes' ELSE 'f' || n END AS key, min(n) AS ord FROM ln GROUP BY 1, 2)
SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE key WHEN 'statutes' THEN 1 WHEN 'year' THEN 2 ELSE 9 END, ord, key) AS INTEGER) AS place FROM k""",
    "inferred_profile": f"WITH {_LINES} SELECT doc_id, CASE WHEN count(DISTINCT n) FILTER (n >= 4) >= 4 THEN 'student_petition_tr' WHEN count(DISTINCT n) FILTER (n <= 3) >= 3 THEN 'insurance_incident_en' ELSE 'generic_printed_form' END AS profile FROM ln WHERE n <= 7 AND quantity < 40 GROUP BY 1",
    "checkbox_groups": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'time' WHEN 1 THEN 'identification' WHEN 2 THEN 'injured' END AS grp,
CASE p_partkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 4 THEN FALSE WHEN 2 THEN CASE WHEN p_partkey % 4 = 0 THEN TRUE END WHEN 3 THEN CASE WHEN p_partkey % 4 = 1 THEN TRUE END END AS marked FROM part""",
    "marked_option": f"""WITH {_LINES}, r AS (SELECT doc_id, n, CAST(quantity % 13 / 100 AS DOUBLE) AS s, row_number() OVER w AS rn, lead(CAST(quantity % 13 / 100 AS DOUBLE)) OVER w AS t FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY CAST(quantity % 13 / 100 AS DOUBLE) DESC, n))
SELECT doc_id, CAST(n AS VARCHAR) AS key FROM r WHERE rn = 1 AND t IS NOT NULL AND s >= 0.05 AND s - t >= 0.015 AND NOT (t > 0.036 AND s - t < 0.02)""",
    "artifact_ids": "SELECT event_id AS seq, user_id || '__' || event_type || '_' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS artifact_id FROM events",
    "page_texts": r"SELECT conv_id AS doc_id, turn // 2 AS page_number, md5(string_agg(trim(text), ' ' ORDER BY turn)) AS text FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1, 2",
    "case_checks": f"WITH {_CASE_ROWS} SELECT case_id, field, actual, matched FROM x",
    "case_report": f"""WITH {_CASE_ROWS}, g AS (SELECT case_id, bool_and(matched) AS good FROM x GROUP BY 1)
SELECT round((SELECT avg(CAST(matched AS DOUBLE)) FROM x), 6) AS field_match_rate, round((SELECT avg(CAST(good AS DOUBLE)) FROM g), 6) AS case_success_rate, round(avg(c_custkey % 10 / 10.0::DOUBLE), 6) AS confidence, round(avg(CAST(c_custkey % 3 = 0 AS DOUBLE)), 6) AS pass_rate, round(avg(CAST(c_custkey % 8 = 0 AS DOUBLE)), 6) AS review_rate FROM customer""",
    "overlapping_words": f"""WITH p AS (SELECT p_partkey, string_split({NORM.format("p_name || ' alpha beta gamma'")}, ' ') AS a, string_split({NORM.format("CASE p_partkey % 3 WHEN 0 THEN 'Alpha beta gamma ' || p_name WHEN 1 THEN 'beta gamma x' ELSE p_name || ' alpha beta gamma' END")}, ' ') AS b FROM part)
SELECT p_partkey, CAST(coalesce(list_filter([8, 7, 6, 5, 4, 3], lambda k: len(a) >= k AND len(b) >= k AND a[len(a) - k + 1 : len(a)] = b[1 : k])[1], 0) AS INTEGER) AS words, CAST(len(list_filter(list_distinct(b), lambda t: NOT list_contains(a, t))) AS INTEGER) AS growth FROM p""",
    "document_profile": """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'tr' WHEN 1 THEN 'en' ELSE 'unknown' END AS g, CASE p_partkey % 4 WHEN 0 THEN 'student_petition' WHEN 1 THEN 'insurance_incident' WHEN 2 THEN 'generic_form' ELSE 'unknown' END AS f,
CASE WHEN p_partkey % 11 >= 6 AND p_partkey % 7 >= 4 THEN 'mixed' WHEN p_partkey % 11 >= 6 THEN 'underline_form' WHEN p_partkey % 7 >= 6 THEN 'boxed_form' WHEN p_partkey % 7 >= 2 THEN 'table_form' ELSE 'unknown' END AS y FROM part)
SELECT k AS p_partkey, y AS layout, CASE WHEN f = 'student_petition' AND g = 'tr' THEN 'student_petition_tr' WHEN f = 'insurance_incident' AND g = 'en' THEN 'insurance_incident_en' WHEN k % 5 = 0 THEN 'generic_handwritten_form' ELSE 'generic_printed_form' END AS profile,
round(least(0.95::DOUBLE, 0.25 + CASE WHEN g <> 'unknown' THEN 0.2 ELSE 0.0 END + CASE WHEN y <> 'unknown' THEN 0.2 ELSE 0.0 END + CASE f WHEN 'generic_form' THEN 0.15 WHEN 'unknown' THEN 0.0 ELSE 0.35 END), 6) AS confidence,
CASE WHEN k % 13 = 0 OR k % 9 / 10.0 < 0.45 THEN 'low_confidence_review' WHEN k % 2 = 1 AND k % 3 > 0 THEN 'existing_acroform' WHEN k % 2 = 0 AND k % 5 > 0 THEN 'blank_template' WHEN k % 2 = 0 THEN 'filled_document' ELSE 'low_confidence_review' END AS route FROM p""",
    "annotations": """WITH p AS (SELECT 'img' || CAST(floor(p_partkey / 10) AS BIGINT) AS sample_id, p_partkey % 5 AS c, CAST(p_partkey * 37 % 500 AS DOUBLE) AS l, CAST(p_partkey * 91 % 700 AS DOUBLE) AS t, CAST(p_partkey % 90 + 1 AS DOUBLE) AS w, CAST(p_partkey % 40 + 1 AS DOUBLE) AS h, p_brand AS x FROM part WHERE p_partkey % 11 <> 0)
SELECT sample_id, ['Police Station', 'Year', 'Statutes', 'Complainant Name'][c + 1] AS key, string_agg(x, ' ' ORDER BY t, l, x) AS value, min(l) AS "left", min(t) AS top, max(l + w) AS "right", max(t + h) AS bottom FROM p WHERE c < 4 GROUP BY sample_id, c""",
    "layout_codes": f"WITH {_FIELDS}, {_PAIRS} SELECT doc_id, 'missing_box:' || k AS code FROM b WHERE bare UNION ALL SELECT doc_id, 'tiny:' || k FROM b WHERE NOT bare AND (r - l < 18 OR m - t < 8) UNION ALL SELECT doc_id, 'overlap:' || x || ':' || y FROM p WHERE iou > 0.04",
    "geometry_scores": f"""WITH {_FIELDS}, {_PAIRS}, w AS (SELECT doc_id, x, max(iou) AS iou FROM p WHERE iou > 0 GROUP BY 1, 2), g AS (SELECT b.doc_id, count(*) AS n, avg(CASE WHEN bare THEN 1.0 ELSE coalesce(w.iou, 0.0) END) AS mean, count(*) FILTER (NOT bare AND (r - l < 18 OR m - t < 8)) AS tiny, count(*) FILTER (bare) AS none FROM b LEFT JOIN w ON w.doc_id = b.doc_id AND w.x = b.k GROUP BY 1)
SELECT doc_id, round(CAST(CASE WHEN n = 1 THEN CASE WHEN none > 0 THEN 0.0 WHEN tiny > 0 THEN 0.72 ELSE 1.0 END ELSE greatest(0.0, greatest(0.0, 1 - mean) - least(0.35, tiny * 0.08)) END AS DOUBLE), 6) AS geometry_score FROM g""",
    "reading_order": f"WITH {_FIELDS} SELECT doc_id, CAST(k AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bare, CASE WHEN NOT bare THEN t END, CASE WHEN NOT bare THEN l END, CAST(k AS VARCHAR)) AS INTEGER) AS place FROM b",
    "continuation_boxes": f"""WITH {_FIELDS}, h AS (SELECT k, t, m + k % 60 AS m, m + k % 60 - t AS h FROM b WHERE NOT bare), n AS (SELECT *, CAST(CASE WHEN h <= 24 THEN 1 WHEN h <= 44 THEN 2 ELSE greatest(2, floor((h + 2) / 20)) END AS BIGINT) AS n FROM h), e AS (SELECT *, unnest(range(n)) AS i FROM n)
SELECT CAST(k AS VARCHAR) AS name, CAST(i AS INTEGER) AS k, round(CASE WHEN n = 1 THEN t ELSE t + h / n * i + 2 END, 6) AS top, round(CASE WHEN n = 1 THEN m ELSE t + h / n * (i + 1) - 2 END, 6) AS bottom FROM e""",
    "distinct_boxes": "SELECT p_partkey % 3 AS kind, min(p_partkey) AS ord FROM part GROUP BY p_partkey % 3, round_even(p_partkey % 40 / 2.0::DOUBLE, 0), round_even(p_partkey % 6 / 2.0::DOUBLE, 0)",
    "lines_and_rules": """WITH a AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey * 37 % 500 AS l, p_partkey * 91 % 200 AS t, p_partkey * 53 % 600 AS x, p_partkey * 17 % 200 AS y FROM part),
j AS (SELECT a.k AS line_id, b.k AS rule_id, b.x - (a.l + 60) AS gap FROM a JOIN a b ON a.d = b.d WHERE b.y + 1 >= a.t - 2 AND b.y <= a.t + 10.5 AND b.x + 80 >= a.l - 6 AND b.x <= a.l + 60 + 160), r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY gap < 0, abs(gap), rule_id) AS rn FROM j)
SELECT line_id, rule_id FROM r WHERE rn = 1""",
    "heading_boxes": """WITH a AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey * 37 % 300 AS l, p_partkey * 91 % 400 AS t, p_partkey * 53 % 300 AS x, p_partkey * 17 % 400 AS y FROM part)
SELECT DISTINCT b.d AS doc_id, b.k AS box_id FROM a b JOIN a ON a.d = b.d AND a.k % 3 = 0 AND a.t >= b.y - 6 AND a.t + 10 <= b.y + 96 AND a.l >= b.x - 8 AND a.l + 60 <= b.x + 158""",
    "long_answers": """WITH f AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey % 20 AS o, p_partkey * 37 % 100 + 50 AS l, p_partkey * 91 % 300 AS t FROM part WHERE p_partkey % 4 = 0),
u AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey * 13 % 60 AS l, p_partkey * 17 % 360 AS t FROM part), a AS (SELECT p_partkey // 20 AS d, p_partkey % 20 AS o, p_partkey * 29 % 360 AS t, p_partkey % 10 <> 0 AND p_partkey % 15 <> 0 AS text FROM part WHERE p_partkey % 5 = 0), w AS (SELECT * FROM a WHERE text),
j AS (SELECT f.d, f.k, u.l, u.t, row_number() OVER (PARTITION BY f.k ORDER BY u.t, u.k) AS rn FROM f JOIN u ON f.d = u.d AND u.l <= f.l + 10 AND u.l + 140 >= f.l + 30 AND u.t + 0.5 > f.t + 13 AND u.t - (f.t + 10) <= 60
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.d = f.d AND w.o > f.o AND w.t <= u.t + 7 AND w.t + 8 >= u.t - 6 AND NOT EXISTS (SELECT 1 FROM a WHERE a.d = f.d AND a.o > f.o AND a.o < w.o AND a.t > u.t + 7)))
SELECT d AS doc_id, k AS field_id, CAST(min(l) AS DOUBLE) AS "left", CAST(min(t) AS DOUBLE) AS top, CAST(max(l + 140) AS DOUBLE) AS "right", CAST(max(t + 1) AS DOUBLE) AS bottom FROM j WHERE rn <= 2 GROUP BY 1, 2""",
    "anchored_boxes": """WITH a AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey % 3 AS w, p_partkey % 50 + 30 AS mw, p_partkey * 37 % 500 AS l, p_partkey * 91 % 700 AS t, p_partkey * 37 % 500 + 60 AS r, p_partkey * 91 % 700 + 10 AS b FROM part WHERE p_partkey % 2 = 0),
u AS (SELECT p_partkey // 20 AS d, p_partkey AS k, p_partkey * 53 % 500 AS l, p_partkey * 17 % 700 AS t, p_partkey * 53 % 500 + 20 + p_partkey % 80 AS r FROM part),
j AS (SELECT a.k, u.l, u.t, u.r, row_number() OVER (PARTITION BY a.k ORDER BY abs(u.t - a.b), abs(u.l - a.r), u.k) AS rn FROM a JOIN u ON a.d = u.d AND u.r - u.l >= a.mw AND CASE a.w WHEN 0 THEN u.t + 1 >= a.t - 8 AND u.t <= a.b + 18 AND u.l >= a.r - 10
WHEN 1 THEN u.t >= a.b - 6 AND u.t <= a.b + 38 AND u.r >= a.l + 40 ELSE u.t + 1 >= a.t - 28 AND u.t <= a.b + 10 AND u.l >= a.l - 10 END),
o AS (SELECT a.*, j.rn, j.l AS jl, j.t AS jt, j.r AS jr, CASE w WHEN 1 THEN a.l WHEN 2 THEN a.r + 8 ELSE a.r + 10 END AS ol, CASE w WHEN 1 THEN a.b + 8 WHEN 2 THEN a.t - 4 ELSE a.t - 2 END AS ot FROM a LEFT JOIN j ON j.k = a.k AND j.rn = 1)
SELECT d AS doc_id, CAST(k AS VARCHAR) AS spec, 1 AS page_number, CAST(CASE WHEN rn = 1 THEN jl ELSE ol END AS DOUBLE) AS "left", CAST(CASE WHEN rn = 1 THEN jt + 1 ELSE greatest(0, ot) END AS DOUBLE) AS top, CAST(CASE WHEN rn = 1 THEN jr ELSE least(571, ol + mw) END AS DOUBLE) AS "right",
CAST(CASE WHEN rn = 1 THEN least(841, jt + 15) ELSE least(818, ot + 14) END AS DOUBLE) AS bottom FROM o WHERE rn = 1 OR least(571, ol + mw) - ol >= 40""",
    "evidence_candidates": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 + 1 ELSE 1 END AS p FROM orders),
c AS (SELECT k, 0 AS i, s AS v, 'llm_page' AS w FROM o WHERE k % 3 <> 0 UNION ALL SELECT k, 1, 'F', 'page_candidate' FROM o WHERE k % 2 = 0 UNION ALL SELECT k, 2, 'O', 'page_precision' FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 4, CASE WHEN k % 5 = 0 THEN 'F' ELSE 'Z' END, 'crop_precision' FROM o WHERE k % 2 = 0),
f AS (SELECT k, v, min(i) AS i, arg_min(w, i) AS w FROM c GROUP BY 1, 2), g AS (SELECT k, string_agg(v || ':' || w, ',' ORDER BY i) AS l FROM f GROUP BY 1)
SELECT o.k AS doc_id, CAST(p AS INTEGER) AS page_number, CASE WHEN o.k % 7 <> 0 THEN 'the_status' ELSE 'status' END AS anchor, coalesce(l, '') AS candidates, 'llm_page' || CASE WHEN p = 1 AND o.k % 9 <> 0 THEN '+transcript' ELSE '' END AS reason FROM o LEFT JOIN g ON g.k = o.k""",
}

_PLAN = f"""{_FIELDS}, n AS (SELECT *, doc_id % 2 = 0 AS pet, ['ad_soyad', 'telefon', 'akts', 'witness_note', 'birth_date', 'policy', 'danisman_gorusu'][k % 7 + 1] || CASE WHEN k % 20 = 6 THEN '' ELSE '_' || k END AS name, CASE WHEN k % 11 = 0 THEN 'multiline' WHEN k % 13 = 0 THEN 'signature' ELSE 'text' END AS kind, m - t AS h, r - l AS wd FROM b),
s AS (SELECT *, pet AND name = 'danisman_gorusu' AS spec FROM n),
w AS (SELECT *, CASE WHEN kind = 'multiline' THEN 'multiline' WHEN kind = 'signature' OR contains(name, 'date') THEN 'date_signature' WHEN contains(name, 'telefon') THEN 'compound_contact' WHEN contains(name, 'akts') THEN 'table_cell' WHEN contains(name, 'witness') OR contains(name, 'gorusu') THEN 'multiline'
WHEN pet AND contains(name, 'ad_soyad') THEN 'inline' WHEN NOT bare AND h >= 26 THEN 'multiline' ELSE 'single_line' END AS writer FROM s),
q AS (SELECT *, CASE WHEN bare THEN 'missing_detected_region' ELSE array_to_string(list_filter([CASE WHEN CASE WHEN spec THEN FALSE ELSE wd < 18 OR h < 8 END THEN 'tiny_target_region' END, CASE WHEN writer = 'multiline' AND h < 20 THEN 'multiline_writer_on_short_region' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM w)"""
SQL |= {
    "render_plan": f"""WITH {_PLAN} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY bare, CASE WHEN NOT bare THEN t END, CASE WHEN NOT bare THEN l END, name) AS INTEGER) AS place, name, writer, CASE writer WHEN 'table_cell' THEN 'table_cell' WHEN 'multiline' THEN 'multiline_block' WHEN 'date_signature' THEN 'date_signature_block' WHEN 'compound_contact' THEN 'compound_contact_row' WHEN 'inline' THEN 'inline_run' ELSE 'single_line_field' END AS container,
kind AS value, CASE WHEN spec THEN 164.0 WHEN NOT bare THEN l END AS "left", CASE WHEN spec THEN 478.0 WHEN NOT bare THEN m END AS bottom,
round(CASE WHEN spec THEN 9.2::DOUBLE WHEN NOT bare THEN CASE writer WHEN 'multiline' THEN greatest(6.0::DOUBLE, least(12.0::DOUBLE, round_even(h * 0.36::DOUBLE, 1))) WHEN 'inline' THEN greatest(6.5::DOUBLE, least(12.0::DOUBLE, round_even(h * 0.68::DOUBLE, 1))) ELSE greatest(6.0::DOUBLE, least(12.0::DOUBLE, round_even(h * 0.75::DOUBLE, 1))) END END, 6) AS font_size,
round(CASE WHEN spec THEN 8.9::DOUBLE WHEN NOT bare AND writer = 'multiline' THEN greatest(6.0::DOUBLE, least(11.0::DOUBLE, round_even(h * 0.3::DOUBLE, 1))) END, 6) AS multiline_font_size, round(CASE WHEN spec THEN 477.2::DOUBLE WHEN NOT bare THEN greatest(t, m - 0.8::DOUBLE) END, 6) AS baseline,
CASE WHEN pet THEN 'student_petition_tr:' ELSE 'generic_printed_form:' END || name AS anchor, warnings FROM q""",
    "render_summary": f"""WITH {_PLAN}, g AS (SELECT doc_id, max(CASE WHEN spec OR NOT bare THEN 1 END) AS pages FROM q GROUP BY 1), v AS (SELECT doc_id, string_agg(DISTINCT x, ',' ORDER BY x) AS warnings FROM (SELECT doc_id, unnest(string_split(warnings, ',')) AS x FROM q WHERE warnings <> '') GROUP BY 1)
SELECT q.doc_id, writer, count(*) AS fields, any_value(g.pages) AS pages, coalesce(any_value(v.warnings), '') AS warnings FROM q JOIN g USING (doc_id) LEFT JOIN v ON v.doc_id = q.doc_id GROUP BY 1, 2""",
}

_CROP_DATE = r"(^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$|^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}$|^(?i:permanent)$)"
_WORDS = "len(list_filter(string_split(trim({0}), ' '), lambda w: w <> ''))"
_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_CODE = "({0} <> '' AND length({0}) <= 16 AND NOT regexp_matches({0}, '" + _CROP_DATE + "') AND regexp_matches({0}, '[/.-]'))"
SQL |= {
    "crop_policy": f"""WITH o AS (SELECT o_orderkey AS k, ['order date', 'year', 'fax no', 'store address', 'supplier', 'approval', 'note'][o_orderkey % 7 + 1] AS l, o_orderkey % 13 = 0 AS box,
CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 5 = 2 THEN 'A/1' ELSE o_orderpriority END AS v,
CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 6 = 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN o_orderkey % 6 = 2 THEN '12 Long Road, Some Town' WHEN o_orderkey % 6 = 3 THEN 'B-2' WHEN o_orderkey % 6 = 4 THEN ' ' ELSE o_orderpriority END AS c FROM orders),
g AS (SELECT *, k % 11 <> 0 AND NOT box AND (v = '' OR CASE l WHEN 'order date' THEN FALSE WHEN 'note' THEN {_CODE.replace('{0}', 'v')} ELSE TRUE END) AND trim(c) <> '' AND (v = '' OR ({NORM.format('v')} <> {NORM.format('c')} AND CASE l WHEN 'order date' THEN regexp_matches(c, '{_CROP_DATE}') WHEN 'year' THEN regexp_full_match(c, '(?:19|20)[0-9][0-9]')
WHEN 'fax no' THEN {_DIGITS.format('c')} >= {_DIGITS.format('v')} WHEN 'store address' THEN [{_WORDS.format('c')}, {_DIGITS.format('c')}, length(trim(c))] > [{_WORDS.format('v')}, {_DIGITS.format('v')}, length(trim(v))] WHEN 'supplier' THEN {_CODE.replace('{0}', 'c')} WHEN 'approval' THEN NOT regexp_full_match(c, '[0-9]+') ELSE FALSE END)) AS go FROM o)
SELECT k AS doc_id, CASE WHEN go THEN c ELSE v END AS value, round(CASE WHEN go THEN CASE WHEN k % 2 = 0 THEN 0.62 - 0.08 ELSE 0.70 END - CASE WHEN l = 'order date' THEN 0.12 ELSE 0.0 END ELSE 0.5 END::DOUBLE, 6) AS confidence, CASE WHEN NOT go THEN 'llm_page' WHEN k % 2 = 0 THEN 'llm_crop_ocr_hint' ELSE 'llm_crop' END AS source_kind,
CASE WHEN NOT go THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'ocr_confusion_risk' END, CASE WHEN l = 'order date' THEN 'ambiguous_date_family' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM g""",
    "long_readings": r"""SELECT conv_id, turn, conv_id % 3 <> 2 AND CASE WHEN trim(text) = '' THEN conv_id % 3 = 1 ELSE contains(text, chr(10)) OR conv_id % 3 = 1 OR length(trim(text)) >= 140 END AS asked, turn % 2 = 0 AS better, trim(text) <> '' AND FALSE AS back FROM conversations""",
    "long_texts": r"""WITH p AS (SELECT p_partkey AS k, concat(p_name, ' of ', p_type, ' sort') AS t FROM part),
m AS (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 6 = 1 THEN concat('A ', t, chr(10), 'no ', k) WHEN k % 6 = 2 THEN concat(t, ' no. ', k, chr(10), 'call 555-123-4567') WHEN k % 6 = 5 THEN concat(t, chr(10), 'mail a@b.org') END AS w FROM p)
SELECT k AS doc_id, CASE WHEN w IS NOT NULL THEN w WHEN k % 6 = 4 THEN '' ELSE concat(t, chr(10)) END AS value, round(CASE WHEN w IS NULL THEN 0.5 WHEN k % 4 = 0 THEN 0.54 ELSE 0.70 END::DOUBLE, 6) AS confidence,
CASE WHEN w IS NULL THEN 'llm_page' WHEN k % 4 = 0 THEN 'llm_crop_ocr_hint' ELSE 'llm_crop' END AS source_kind, CASE WHEN w IS NOT NULL AND k % 4 = 0 THEN 'ocr_confusion_risk' ELSE '' END AS reasons FROM m""",
}
