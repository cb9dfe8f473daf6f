"""Queries of extraction results, names, packs, runs and layout boxes over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix, naming, render, results
from ..sources import regions, tables


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def evidence_values(spark, d):
    """Values of orders from evidence with and without parts of its confidence, and read ones for the others."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    parts = F.when(k % 4 == 0, F.create_map(F.lit("selected"), F.lit(None).cast("double"), F.lit("overall"), F.lit(0.5))).when(k % 4 == 1, F.create_map(F.lit("field_confidence"), k % 10 / 10.0, F.lit("overall"), F.lit(0.5))).when(k % 4 == 2, F.create_map(F.lit("overall"), F.lit(0.5)))
    seen = F.array(F.struct(F.col("o_orderstatus").alias("value"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("raw_text"))).cast("array<struct<value:string,raw_text:string>>")
    rows = o.where(k % 5 != 0).select(k.alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), F.when(k % 7 == 0, " ").otherwise(" status ").alias("field_key"), F.col("o_orderstatus").alias("s"), parts.alias("breakdown"), F.when(k % 6 < 4, seen).alias("candidates"), F.when(k % 2 == 0, "").otherwise("agreed").alias("reason"))
    found = results.values_of_evidence(rows.withColumn("resolved_value", F.concat("s", F.col("ord").cast("string"))))
    read = o.select(k.alias("doc_id"), F.lit(0).alias("ord"), F.lit("status").alias("source_key"), F.col("o_orderstatus").alias("value"), F.lit(0.3).alias("confidence"), F.col("o_orderstatus").alias("raw_text"), F.lit("page").alias("source_kind"))
    return results.resolved_or_read(found, read)


def _extraction(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    rows = tables.spread(lines, "l_orderkey", "l_linenumber").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("q"))
    key = F.concat(F.lit("k"), F.col("ord").cast("string")).alias("source_key")
    reasons = F.when(F.col("q") % 5 == 0, F.array(F.lit("expected_empty"))).when(F.col("q") % 5 == 1, F.array(F.lit("ambiguous_date_family"))).otherwise(F.array().cast("array<string>"))
    values = rows.select("doc_id", "ord", key, F.when(F.col("q") % 3 == 0, "").otherwise(F.col("flag")).alias("value"), (F.col("q") / 40).alias("confidence"), F.col("flag").alias("raw_text"), F.lit("llm_page").alias("source_kind"), reasons.alias("review_reasons"))
    status = F.when(F.col("q") > 30, "mapped").otherwise("needs_review")
    mappings = rows.where(F.col("q") % 7 != 0).select("doc_id", "ord", key, F.concat(F.lit("t"), (F.col("ord") % 3).cast("string")).alias("target_field"), (F.col("q") / 50).alias("confidence"), status.alias("status"))
    return values, mappings


def extraction_results(spark, d):
    out = results.extraction_results(*_extraction(spark, d))
    return out.withColumn("confidence", F.round("confidence", 6))


def extraction_payloads(spark, d):
    values, mappings = _extraction(spark, d)
    fields = F.from_json("fields", "array<struct<key:string,value:string,mapped_target:string,review_reasons:array<string>>>")
    shown = F.array_join(F.transform(fields, lambda f: F.concat_ws("|", f["key"], f["value"], f["mapped_target"], F.array_join(f["review_reasons"], ","))), ";")
    return results.extraction_payload(values, mappings).select("doc_id", shown.alias("fields"))


def transcripts(spark, d):
    p = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("page_number"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    cells, boxes = _t(spark, d, "labels").where("quality = 1").select("doc_id"), _t(spark, d, "labels").where("toxic = 1").select("doc_id")
    trust = results.transcript_confidence(F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("doc_id") % 10 / 10.0, F.lit("b"), F.lit(0.35))), F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit(1), F.col("text"))))
    return results.transcript_summary(p, lines, cells, boxes).join(p.select("doc_id", F.round(trust, 6).alias("confidence")), "doc_id")


def feedback(spark, d):
    k = F.col("o_orderkey")
    warn = F.transform(F.sequence(F.lit(1), (k % 8).cast("int") + 1), lambda i: F.concat(F.lit("w"), i.cast("string")))
    seen = F.struct((k % 3 == 0).alias("passed"), (k % 4 == 0).alias("review_required"), (k % 100 / 100.0).alias("overall_score"), warn.alias("warnings"))
    rows = _t(spark, d, "orders").select(k.alias("doc_id"), F.lower("o_orderpriority").alias("route"), (k % 50 / 50.0).alias("confidence"), F.when(k % 5 > 0, seen).alias("verification"))
    return results.user_feedback(rows).select("doc_id", "summary", "review_required", F.array_join("highlights", ",").alias("highlights"))


def name_reviews(spark, d):
    """Names of parts against their labels, by brand."""
    k = F.col("p_partkey")
    fields = _t(spark, d, "part").select(F.col("p_brand").alias("doc_id"), k.alias("ord"), F.when(k % 4 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 4 == 1, F.concat(F.lit("field_"), k.cast("string"))).otherwise(F.col("p_name")).alias("name"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("label"))
    reviews = naming.name_reviews(fields)
    moved = naming.renames(reviews).select("doc_id", "current_name", F.col("recommended_name").alias("renamed"))
    return reviews.drop("reason").join(moved, ["doc_id", "current_name"], "left")


def mapped_names(spark, d):
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("doc_id"), k.alias("ord"), F.col("p_name").alias("source_key"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("t"), (k % 50).cast("string"))).alias("target_field"))
    return naming.renames_of_mappings(rows)


def field_kinds(spark, d):
    """Kinds of fields by what is drawn, printed or coded, over the parts."""
    k, c = F.col("p_partkey"), F.col
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    text = F.concat("p_name", pick(" : ...", ".....", "____", " / 20", ""))
    rows = _t(spark, d, "part").select(k.alias("k"), text.alias("t"), naming.placeholder_kind(text).alias("a"), naming.rect_kind(F.lit(5), F.lit(3), 5 + k % 60, 3 + k % 23).alias("b"), naming.cell_kind(F.concat("p_name", pick(" Tarihi", " Öğrenci No", " Kredi")), k % 60).alias("c"), naming.kind_of_code(pick("/Btn", "/Tx", "/Sig", "/Ch", "/X")).alias("code"), naming.kind_of_word(pick(" Check", "RADIO ", "textarea", "numeric", "p", "date", "text")).alias("word"), naming.is_ticked(pick(" X", "y", "no", "Checked", "")).alias("ticked"), naming.detection_confidence(k % 100 / 100.0, k % 2 == 0, k % 3 == 0).alias("conf"), naming.display_label(F.concat("p_name", F.lit("_no_1a__body"))).alias("title"), naming.footnote_label(F.concat(pick("incident_", "my_witness_", "injury_", "the address", "", "___"), F.col("p_name"))).alias("note"), naming.anchor_key(F.concat("p_type", F.lit("  "), "p_name")).alias("anchor"), naming.safe_folder(F.concat(F.lit("/"), "p_name", F.lit("?!"))).alias("folder"))
    return rows.select("k", c("a.pattern").alias("text_pattern"), c("a.kind").alias("text_kind"), c("b.pattern").alias("rect_pattern"), c("b.confidence").alias("rect_confidence"), c("c.kind").alias("cell_kind"), c("c.confidence").alias("cell_confidence"), "code", "word", "ticked", F.round("conf", 6).alias("conf"), "title", "note", "anchor", "folder")


def _pack(spark, d):
    names = F.array(*map(F.lit, [*matrix.PACK_LIMITS, "other"]))
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(F.get(names, (k % 7).cast("int")).alias("dataset"), F.col("o_orderpriority").alias("bucket"), F.lpad(k.cast("string"), 12, "0").alias("sample_id"), (k % 9 + 1).alias("fields"), F.least(k % 9 + 1, k % 11).alias("exact"), F.least(k % 9 + 1, k % 13 + 4).alias("covered"), F.least(k % 9 + 1, k % 12 + 2).alias("matched"), (k % 5 > 0).alias("success"), (k % 100 / 100.0).alias("confidence"), (k % 4 == 0).alias("review"))


def pack_subset(spark, d):
    return matrix.pack_subset(_pack(spark, d), matrix.pack_limits(spark, "tuning", 40).where("dataset <> 'fir'")).select("dataset", "bucket", "sample_id")


def validation_matrix(spark, d):
    out = matrix.validation_matrix(_pack(spark, d), True)
    return out.withColumn("actual", F.round("actual", 6))


def render_runs(spark, d):
    """What each writer writes of contacts, dates and texts made from orders."""
    k = F.col("o_orderkey")
    ways = ["compound_contact", "date_signature", "multiline", "inline"]
    date = F.date_format("o_orderdate", "dd.MM.yyyy")
    value = F.when(k % 5 == 0, F.concat(F.lit(" a"), k.cast("string"), F.lit("@x.org /  555-123-4567 ; ;"), "o_orderstatus")).when(k % 5 == 1, F.concat(date, F.lit(" / "), "o_orderpriority")).when(k % 5 == 2, F.concat(date, F.lit("  "), "o_orderstatus")).when(k % 5 == 3, F.concat("o_orderpriority", F.lit("\n\n  "), "o_orderstatus", F.lit("\r\nend "))).otherwise(" / ")
    rows = _t(spark, d, "orders").select(k.alias("doc_id"), F.get(F.array(*map(F.lit, ways)), (k % 4).cast("int")).alias("writer"), value.alias("value"))
    return rows.select("doc_id", F.posexplode(render.runs(F.col("writer"), F.col("value"))).alias("place", "r")).select("doc_id", "place", "r.text", "r.role")


def layout_regions(spark, d):
    """Boxes of parts in every shape of JSON, in pixels, some off the page or broken."""
    k = F.col("p_partkey")
    a, b = k * 37 % 700 - 50, k * 53 % 900 - 20
    c, e = a + k % 40, b + 20
    item = F.expr("""CASE p_partkey % 6 WHEN 0 THEN format_string('{"bbox": [%d, %d, %d, "%d"]}', a, b, c, e) WHEN 1 THEN format_string('{"polygon": [[%d, %d], [%d, %d, 7], [3], [%d, %d]]}', a, e, c, b, a, b) WHEN 2 THEN format_string('{"points": [[%d, %d], [%d, %d]], "bbox": null}', a, b, c, e)
        WHEN 3 THEN format_string('{"x1": %d, "y1": %d, "x2": %d, "y2": %d}', a, b, c, e) WHEN 4 THEN format_string('{"bbox": [%d, %d, %d]}', a, b, c) ELSE format_string('{"x1": %d, "y1": null, "x2": %d}', a, c) END""")
    rows = _t(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("e")).withColumn("one", item)
    payload = F.expr("""CASE p_partkey % 5 WHEN 0 THEN concat('[', one, ']') WHEN 1 THEN concat('{"bboxes": [], "layout": [', one, ', ', one, ']}') WHEN 2 THEN concat('{"boxes": [', one, ']}') WHEN 3 THEN concat('{"predictions": [5, ', one, ']}') ELSE concat('{', one) END""")
    return regions.region_boxes(rows.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_number"), payload.alias("payload"), F.lit(600).alias("width"), F.lit(800).alias("height")))


QUERIES = {f.__name__: f for f in (
    evidence_values, extraction_results, extraction_payloads, transcripts, feedback, name_reviews, mapped_names, field_kinds, pack_subset, validation_matrix, render_runs, layout_regions,
)}

_LINES = """r AS (SELECT l_orderkey AS d, l_linenumber AS n, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
v AS (SELECT d, n, concat('k', n) AS key, CASE WHEN q % 3 = 0 THEN '' ELSE f END AS value, q / 40 AS c, CASE WHEN q % 5 = 0 THEN 'expected_empty' WHEN q % 5 = 1 THEN 'ambiguous_date_family' END AS reason FROM r),
m AS (SELECT d, n, concat('k', n) AS key, concat('t', n % 3) AS target, q / 50 AS c, CASE WHEN q > 30 THEN 'mapped' ELSE 'needs_review' END AS status FROM r WHERE q % 7 <> 0)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in [*matrix.PACK_LIMITS, "other"]) + "]"
_PACK = f"p AS (SELECT {_NAMES}[o_orderkey % 7 + 1] AS dataset, o_orderpriority AS bucket, lpad(o_orderkey::VARCHAR, 12, '0') AS sample_id, o_orderkey AS k, o_orderkey % 9 + 1 AS fields FROM orders)"
_PART_SLUG = "trim(regexp_replace(regexp_replace(lower({0}), '([0-9]+)', ' \\1 ', 'g'), '[^a-z0-9]+', '_', 'g'), '_')"
SQL = {
    "evidence_values": """WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
SELECT k AS doc_id, 0 AS ord, 'status' AS source_key, concat(s, '1') AS value, CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN k % 10 / 10.0 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN k % 6 < 4 THEN CASE WHEN k % 3 = 0 THEN s ELSE p END ELSE concat(s, '1') END AS raw_text, CASE WHEN k % 2 = 0 THEN 'resolver_evidence' ELSE 'agreed' END AS source_kind FROM e
UNION ALL SELECT o_orderkey, 0, 'status', o_orderstatus, 0.3::DOUBLE, o_orderstatus, 'page' FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""",
    "extraction_results": f"""WITH {_LINES}, items AS (SELECT d, key, reason FROM v WHERE reason IS NOT NULL AND reason <> 'expected_empty' UNION SELECT d, key, 'missing_value' FROM v WHERE value = '' AND reason IS DISTINCT FROM 'expected_empty' UNION SELECT d, key, 'low_mapping_confidence' FROM m WHERE status <> 'mapped'),
rows AS (SELECT v.d, 1 AS v, 0 AS m, 0 AS w, least(1, greatest(0, c)) AS c FROM v UNION ALL SELECT m.d, 0, 1, CASE WHEN m.c < 0.6 AND v.reason IS DISTINCT FROM 'expected_empty' THEN 1 ELSE 0 END, least(1, greatest(0, m.c)) FROM m JOIN v USING (d, key)),
a AS (SELECT d, sum(v) AS v, sum(m) AS m, sum(w) AS w, avg(c) AS c FROM rows GROUP BY d)
SELECT d AS doc_id, CAST(v AS BIGINT) AS n_values, CAST(m AS BIGINT) AS n_mappings, CAST(w AS BIGINT) AS weak_mappings, (SELECT count(*) FROM items i WHERE i.d = a.d) AS review_items, round(c::DOUBLE, 6) AS confidence, CASE WHEN w > 0 THEN 'data.mapping.review_required' END AS issue FROM a""",
    "extraction_payloads": f"""WITH {_LINES} SELECT v.d AS doc_id, string_agg(concat_ws('|', v.key, v.value, coalesce(m.target, ''), coalesce(v.reason, '')), ';' ORDER BY v.key) AS fields FROM v LEFT JOIN m USING (d, key) GROUP BY v.d""",
    "transcripts": """SELECT d.doc_id, 1::BIGINT AS pages, CASE WHEN d.doc_id % 4 <> 0 AND regexp_matches(text, '\\S') THEN 1 ELSE 0 END::BIGINT AS filled_pages, len(string_split(text, chr(10)))::BIGINT AS lines,
(SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS cells, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS boxes, round(CASE WHEN d.doc_id % 2 = 0 THEN greatest(d.doc_id % 10 / 10.0, 0.35) WHEN d.doc_id % 3 = 0 THEN 0.7 ELSE 0 END::DOUBLE, 6) AS confidence FROM documents d""",
    "feedback": """WITH o AS (SELECT o_orderkey AS k, printf('route=%s confidence=%.3f', lower(o_orderpriority), (o_orderkey % 50 / 50.0)::DOUBLE) AS base, o_orderkey % 5 > 0 AS seen FROM orders)
SELECT k AS doc_id, CASE WHEN seen THEN printf('%s verify_score=%.3f review=%s', base, (k % 100 / 100.0)::DOUBLE, CASE WHEN k % 4 = 0 THEN 'required' ELSE 'not_required' END) ELSE base END AS summary, seen AND k % 4 = 0 AS review_required,
CASE WHEN seen THEN array_to_string(list_concat([CASE WHEN k % 3 = 0 THEN 'verification_passed' ELSE 'verification_failed' END], list_transform(range(1, least(k % 8 + 1, 5) + 1), lambda i: concat('w', i))), ',') ELSE '' END AS highlights FROM o""",
    "name_reviews": """WITH f AS (SELECT p_brand AS d, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat('field_', p_partkey) ELSE p_name END AS name, p_name FROM part),
g AS (SELECT *, CASE WHEN k % 3 = 0 THEN name ELSE p_name END AS label FROM f), s AS (SELECT *, replace(lower(label), ' ', '_') AS slug FROM g), u AS (SELECT *, row_number() OVER (PARTITION BY d, slug ORDER BY k) AS i FROM s),
w AS (SELECT *, CASE WHEN i = 1 THEN slug ELSE concat(slug, '_', i) END AS rec FROM u), x AS (SELECT *, name = rec AND NOT regexp_matches(name, '^field_[0-9]+$') AS ok FROM w)
SELECT d AS doc_id, k AS ord, name AS current_name, rec AS recommended_name, ok AS is_valid, max_by(CASE WHEN NOT ok AND name <> rec THEN rec END, CASE WHEN NOT ok AND name <> rec THEN k END) OVER (PARTITION BY d, name) AS renamed FROM x""",
    "mapped_names": """WITH r AS (SELECT p_brand AS d, p_partkey AS k, replace(lower(p_name), ' ', '_') AS slug, concat('t', p_partkey % 50) AS t FROM part WHERE p_partkey % 5 <> 0), u AS (SELECT *, row_number() OVER (PARTITION BY d, slug ORDER BY k) AS i FROM r)
SELECT d AS doc_id, t AS target_field, max_by(CASE WHEN i = 1 THEN slug ELSE concat(slug, '_', i) END, k) AS name FROM u GROUP BY 1, 2""",
    "field_kinds": r"""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_type AS y, concat(p_name, [' : ...', '.....', '____', ' / 20', ''][p_partkey % 5 + 1]) AS t, p_partkey % 60 AS w, p_partkey % 23 AS h FROM part),
r AS (SELECT *, CASE WHEN w <= 15 AND h <= 15 AND abs(w - h) <= 4 THEN 'checkbox' WHEN w >= 45 AND h <= 18 THEN 'rect_box' ELSE 'unknown' END AS rp, ['incident_', 'my_witness_', 'injury_', 'the address', '', '___'][k % 6 + 1] AS o FROM p)
SELECT k, ['colon_dots', 'bare_dots', 'underline', 'placeholder', 'unknown'][k % 5 + 1] AS text_pattern, ['text', 'text', 'text', 'date', 'unknown'][k % 5 + 1] AS text_kind, rp AS rect_pattern, CASE rp WHEN 'checkbox' THEN 0.82 WHEN 'rect_box' THEN 0.65 ELSE 0 END::DOUBLE AS rect_confidence,
CASE WHEN k % 3 = 0 THEN 'date' ELSE 'number' END AS cell_kind, CASE WHEN w > 24 THEN 0.74 ELSE 0.58 END::DOUBLE AS cell_confidence, ['checkbox', 'text', 'signature', 'text', 'unknown'][k % 5 + 1] AS code, ['checkbox', 'radio', 'multiline', 'number', 'unknown', 'date', 'text'][k % 7 + 1] AS word, k % 5 IN (0, 1, 3) AS ticked,
round(CASE WHEN k % 3 = 0 THEN greatest(0, CASE WHEN k % 2 = 0 THEN least(1, k % 100 / 100.0 + 0.03) ELSE k % 100 / 100.0 END - 0.05) WHEN k % 2 = 0 THEN least(1, k % 100 / 100.0 + 0.03) ELSE k % 100 / 100.0 END::DOUBLE, 6) AS conf,
concat(array_to_string(list_transform(string_split(n, ' '), lambda x: concat(upper(x[1]), x[2:])), ' '), ' No 1A') AS title, CASE k % 6 WHEN 0 THEN 'Incident' WHEN 1 THEN 'Witnesses' WHEN 2 THEN 'Injuries' WHEN 3 THEN 'Address' ELSE array_to_string(list_transform(string_split(n, ' ')[1:2], lambda x: concat(upper(x[1]), x[2:])), ' ') END AS note,
left(replace(lower(concat(y, ' ', n)), ' ', '_'), 80) AS anchor, replace(n, ' ', '_') AS folder FROM r""",
    "pack_subset": f"""WITH {_PACK}, l(dataset, most) AS (VALUES {", ".join(f"('{n}', {min(40, x['tuning'])})" for n, x in matrix.PACK_LIMITS.items() if n != 'fir')}), t AS (SELECT p.*, most, row_number() OVER (PARTITION BY dataset, bucket ORDER BY sample_id) AS turn FROM p LEFT JOIN l USING (dataset)),
q AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY turn, bucket, sample_id) AS place FROM t) SELECT dataset, bucket, sample_id FROM q WHERE most IS NULL OR place <= most""",
    "validation_matrix": f"""WITH {_PACK}, m AS (SELECT dataset, sum(least(fields, k % 11)) / sum(fields) AS field_normalized_exact_match, sum(least(fields, k % 13 + 4)) / sum(fields) AS field_coverage, sum(least(fields, k % 12 + 2)) / sum(fields) AS field_match_rate, avg((k % 5 > 0)::INT) AS case_success_rate FROM p GROUP BY dataset),
l AS (UNPIVOT m ON field_normalized_exact_match, field_coverage, field_match_rate, case_success_rate INTO NAME metric VALUE actual), t(dataset, metric, least) AS (VALUES ('funsd_plus', 'field_normalized_exact_match', 0.90), ('funsd_plus', 'field_coverage', 0.98), ('fir', 'field_normalized_exact_match', 0.72), ('fir', 'field_coverage', 0.88), ('template_e2e', 'field_match_rate', 0.97), ('template_e2e', 'case_success_rate', 0.80)),
g AS (SELECT dataset, metric, actual, least::DOUBLE AS least, actual >= least AS passed FROM l JOIN t USING (dataset, metric) UNION ALL SELECT 'real_demo', 'manual_visual_pass', 1.0, 1.0, TRUE)
SELECT dataset, metric, round(actual::DOUBLE, 6) AS actual, least, passed FROM g UNION ALL SELECT dataset, NULL, NULL, NULL, bool_and(passed) FROM g GROUP BY ROLLUP (dataset)""",
    "render_runs": r"""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, strftime(o_orderdate, '%d.%m.%Y') AS d FROM orders),
v AS (SELECT k, k % 4 AS w, CASE k % 5 WHEN 0 THEN concat('a', k, '@x.org / 555-123-4567 ; ;', s) WHEN 1 THEN concat(d, ' / ', p) WHEN 2 THEN concat(d, ' ', s) WHEN 3 THEN concat(p, ' ', s, ' end') ELSE '/' END AS plain, p, s, d FROM o),
r AS (SELECT *, CASE w WHEN 0 THEN CASE k % 5 WHEN 0 THEN [['email', concat('a', k, '@x.org')], ['phone', '555-123-4567'], ['body', s]] WHEN 1 THEN [['body', d], ['body', p]] ELSE [['body', plain]] END
WHEN 1 THEN CASE k % 5 WHEN 0 THEN [['date', concat('a', k, '@x.org')], ['signature', concat('555-123-4567 ; ;', s)]] WHEN 1 THEN [['date', d], ['signature', p]] WHEN 2 THEN [['date', plain]] ELSE [['body', plain]] END
WHEN 2 THEN CASE k % 5 WHEN 3 THEN [['line_1', p], ['line_2', s], ['line_3', 'end']] ELSE [['line_1', plain]] END ELSE [['body', plain]] END AS x FROM v)
SELECT k AS doc_id, CAST(i - 1 AS INTEGER) AS place, x[i][2] AS text, x[i][1] AS role FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM r)""",
    "layout_regions": """WITH p AS (SELECT p_partkey AS k, p_partkey * 37 % 700 - 50 AS a, p_partkey * 53 % 900 - 20 AS b, p_partkey * 37 % 700 - 50 + p_partkey % 40 AS c, p_partkey * 53 % 900 AS e FROM part WHERE p_partkey % 6 < 4 AND p_partkey % 5 < 4),
i AS (SELECT *, unnest(CASE k % 5 WHEN 1 THEN [0, 1] WHEN 3 THEN [1] ELSE [0] END) AS item FROM p), g AS (SELECT *, greatest(0, least(a, 600))::DOUBLE AS l, greatest(0, least(b, 800))::DOUBLE AS t, greatest(0, least(c, 600))::DOUBLE AS r, greatest(0, least(e, 800))::DOUBLE AS m FROM i)
SELECT k AS doc_id, 1 AS page_number, CAST(item AS INTEGER) AS item, l AS "left", t AS top, r AS "right", m AS bottom FROM g WHERE r > l AND m > t""",
}
