"""Queries of value forms, box forms, payloads, and manifests over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import identity, retry, review, sampling, verify
from ..sources import manifests
from ..streaming import jobs


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def value_forms(spark, d):
    """Names, report years, choices, stations and contact labels made from parts."""
    k, name = F.col("p_partkey"), F.col("p_name")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    person = F.concat(pick("Dr ", "r ", "", "J "), name, pick(", S.I.", " Inspector of Police", "", " Sub-Inspector 7"))
    report = F.concat(name, pick(", 2019", " 1998 ", " 2019x", ", 19"))
    choice = F.concat_ws(" ", pick("cash", "[x]", "card"), pick("x", "other", "[X]", "✓"), name)
    station = F.concat(pick("P.S. ", "Police Station ", "FIR no. ", ""), name, F.lit(" "), k.cast("string"), pick("", " -", ", Year"))
    return _t(spark, d, "part").select(
        k.alias("k"), text.canonical_name(person).alias("person"), text.strip_role(person).alias("bare"), text.report_year(report).alias("year"), text.without_report_year(report).alias("rest"),
        verify.marked_choice(choice).alias("choice"), retry.clean_station(station).alias("station"), retry.contact_label(pick("Phone no", "FAX", "Tel.", "mobile:", " E-mail ", "email", "Post")).alias("label"),
    )


def box_forms(spark, d):
    """Boxes of parts put in order and scaled, and the box around all parts of a brand."""
    k = F.col("p_partkey")
    at = lambda a, b: (k * a % b - 50).cast("double")
    box = geometry.canonical(F.lit(1), at(37, 500), at(91, 700), at(53, 500), at(17, 700))
    rows = _t(spark, d, "part").select(k.alias("k"), "p_brand", box.alias("box"))
    sized = F.struct(F.lit(1).alias("page_number"), *[F.col(f"box.{c}").alias(c) for c in ("left", "top", "right", "bottom")], F.when(k % 3 == 0, 0.0).otherwise(250.0).alias("reference_width"), F.lit(500.0).alias("reference_height"))
    scaled = geometry.scaled(sized, F.lit(1000.0), F.lit(800.0))
    around = rows.groupBy("p_brand").agg(*geometry.union("box")).select("p_brand", *[F.col(c).alias(f"u_{c}") for c in ("left", "top", "right", "bottom")])
    return _t(spark, d, "part").select(k.alias("k"), "p_brand", box.alias("box"), scaled.alias("s")).join(around, "p_brand").select("k", "box.left", "box.top", "box.right", "box.bottom", F.round("s.right", 6).alias("s_right"), F.round("s.bottom", 6).alias("s_bottom"), "u_left", "u_top", "u_right", "u_bottom")


def classified_counts(spark, d):
    """The kind of each order as a document, from counts alone, with what a model says of it."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("existing"), F.count_if(F.col("l_returnflag") == "A").alias("found"), F.sum((F.col("l_quantity") * 7).cast("long")).alias("chars"), F.count("*").alias("pages"))
    own = identity.classify(F.col("existing"), F.col("found"), F.col("chars"), F.col("pages") - 1)
    rows = lines.select("l_orderkey", own.alias("c"), "chars")
    said = F.when(F.col("chars") % 3 == 0, " Flat").when(F.col("chars") % 3 == 1, "ACROFORM ").otherwise("scan")
    return rows.select(F.col("l_orderkey").alias("k"), F.round("c.confidence", 6).alias("confidence"), "c.review_required", identity.coerced(said, ["acroform", "flat"], F.col("c.document_kind")).alias("kind"), F.round(identity.merged_confidence(F.col("c.confidence"), (F.col("chars") % 120).cast("double")), 6).alias("merged"))


def contact_transcripts(spark, d):
    """What follows each contact label in texts of orders."""
    k = F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("Phone: 555-"), k, F.lit(" ; Fax: "), "o_orderstatus", F.lit("\nnothing\nTel: x"), k, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nphone: 1"), k, F.lit("\nPhone: 555-"), k)).otherwise(F.lit("\nFax:  ")))
    return retry.contact_lines(_t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), said.alias("text")))


def payload_fields(spark, d):
    """Fields of JSON payloads in both shapes, made from orders."""
    o = _t(spark, d, "orders").withColumn("conf", F.expr("cast(o_orderkey % 10 as int)"))
    listed = F.expr("""concat('{"fields": [{"key": "status", "value": "', o_orderstatus, '", "confidence": 0.', conf, '}, {"key": "day", "value": "', o_orderpriority, '"}]}')""")
    mapped = F.expr("""concat('{"fields": {"status": {"value": "', o_orderstatus, '", "confidence": 0.', conf, '}, "day": "', o_orderpriority, '"}}')""")
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, listed).when(F.col("o_orderkey") % 3 == 1, mapped).otherwise(F.lit("{}")).alias("payload"))
    return manifests.payload_values(rows)


def linked_forms(spark, d):
    """Questions of parts and the answers linked to them, with the box around these."""
    k = F.col("p_partkey")
    ints = lambda *xs: F.array(*[F.lit(x) if isinstance(x, int) else x for x in xs]).cast("array<int>")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array((k % 50 + i * 20).cast("double"), (k % 7 + i).cast("double"), (k % 50 + i * 20 + 15).cast("double"), (k % 7 + i + 10).cast("double")))
    rows = _t(spark, d, "part").select(
        k.cast("string").alias("sample_id"), F.concat(F.array(F.lit("Name"), F.lit("of"), F.lit("it")), F.split("p_name", " "), F.array("p_brand")).alias("words"), ints(0, 2, 2, 3, (k % 4).cast("int"), 3).alias("labels"),
        F.array(ints(0, 1, 2), ints(3, 4), ints(5)).alias("grouped_words"), F.when(k % 3 == 0, F.array(ints(0, 1), ints(2, 0))).when(k % 3 == 1, F.array(ints(1, 0), ints(1, 2))).otherwise(F.array(ints(0, 2))).alias("linked_groups"), boxes.alias("bboxes"),
    )
    return manifests.linked_fields(rows).select("sample_id", "key", "value", "kind", "box.left", "box.top", "box.right", "box.bottom")


def manifest_rows(spark, d):
    """Expected fields of samples made from orders: of pages, of the sample itself, and repeated ones."""
    k = F.col("o_orderkey")
    field = "struct<key:string,value:string,kind:string,page_number:int,box:array<double>>"
    one = lambda key, value, page=None: F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(None).cast("string").alias("kind"), F.lit(page).cast("int").alias("page_number"), F.lit(None).cast("array<double>").alias("box")).cast(field)
    page = lambda n, fields: F.struct(F.lit(n).cast("int").alias("page_number"), F.lit(10).alias("width"), F.lit(20).alias("height"), fields.cast(f"array<{field}>").alias("expected_fields"))
    status, day = F.col("o_orderstatus"), F.col("o_orderpriority")
    pages = F.when(k % 3 == 0, F.array(page(None, F.array(one("status", status), one("status", day))), page(7, F.array(one("day", day), one("other", status, 9)))))
    pages = pages.when(k % 3 == 1, F.array(page(None, F.lit(None)), page(None, F.lit(None))))
    rows = _t(spark, d, "orders").select(
        F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.when(k % 2 == 0, "train").alias("split"), F.when(k % 5 == 0, 4).cast("int").alias("page_number"), F.lit(None).cast(f"struct<page_number:int,width:int,height:int,expected_fields:array<{field}>>").alias("page"), pages.alias("pages"),
        F.array(one("own", status)).alias("expected_fields"),
    )
    return manifests.manifest_fields(manifests.manifest_samples(rows, "orders")).select("split", "sample_id", "ord", "key", "page_number", "value", "kind")


def release_buckets(spark, d):
    """Orders by stratum, and how many of each."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max(F.col("l_quantity") > 48).alias("long"), F.max("l_linenumber").alias("pages"), F.sum("l_linenumber").alias("w"))
    bucket = sampling.release_bucket(F.col("n") * 2, F.col("long"), F.col("pages") - 2, F.col("w"), F.col("n") * 3)
    return lines.select(bucket.alias("b")).groupBy("b.density", "b.lines", "b.pages", "b.aspect").count().withColumnRenamed("count", "n")


def planned_regions(spark, d):
    """Which fields of orders are read again, from their boxes, the values under labels and names, and the density of pages."""
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("q"))
    page = (F.col("n") % 2 + 1).cast("int")
    name = F.concat(F.lit("f"), F.col("n").cast("string"), F.when(F.col("q") % 5 == 0, "__body").otherwise(""))
    box = F.when(F.col("q") % 11 != 0, F.struct(page.alias("page_number"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(1.0).alias("right"), F.lit(1.0).alias("bottom")))
    fields = rows.select("doc_id", name.alias("name"), F.when(F.col("q") % 3 == 0, F.concat(F.lit("l"), F.col("n").cast("string"))).otherwise("").alias("label"), F.when(F.col("flag") == "R", "date").otherwise("text").alias("kind"), box.alias("box"))
    key = F.when(F.col("q") % 3 == 0, F.concat(F.lit("l"), F.col("n").cast("string"))).otherwise(name)
    values = rows.where("q % 7 <> 0").select("doc_id", key.alias("source_key"), F.when(F.col("q") % 4 == 0, " ").otherwise(F.col("flag")).alias("value"), (F.col("q") / 50).alias("confidence"))
    pages = rows.select("doc_id", page.alias("page_number")).distinct().withColumn("density", (F.col("doc_id") % 10 + F.col("page_number")) / 10)
    return review.region_plan(review.region_targets(fields, values, pages, ["f1"]), [], 3)


def stuck_jobs(spark, d):
    """The last state of every user's events as a job, failed if nothing came for a day before the last event of all."""
    k = F.col("event_id") % 31
    event = F.when(k == 0, "failed").when(k == 1, "succeeded").when(k < 6, "running").otherwise("step")
    rows = _t(spark, d, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), event.alias("event"), F.col("event_type").alias("step"), "ts")
    return jobs.latest_patiently(rows, 86_400)


QUERIES = {f.__name__: f for f in (value_forms, box_forms, classified_counts, contact_transcripts, payload_fields, linked_forms, manifest_rows, release_buckets, planned_regions, stuck_jobs)}

SQL = {
    "box_forms": """WITH p AS (SELECT p_partkey AS k, p_brand, (p_partkey * 37 % 500 - 50)::DOUBLE AS a, (p_partkey * 91 % 700 - 50)::DOUBLE AS b, (p_partkey * 53 % 500 - 50)::DOUBLE AS c, (p_partkey * 17 % 700 - 50)::DOUBLE AS e FROM part),
q AS (SELECT *, greatest(least(a, c), 0) AS l, greatest(least(b, e), 0) AS t FROM p), r AS (SELECT *, greatest(greatest(a, c), l + 1) AS r, greatest(greatest(b, e), t + 1) AS m FROM q)
SELECT k, l AS "left", t AS top, r AS "right", m AS bottom, round(r * CASE WHEN k % 3 = 0 THEN 1 ELSE 4 END, 6) AS s_right, round(m * 1.6::DOUBLE, 6) AS s_bottom, min(l) OVER w AS u_left, min(t) OVER w AS u_top, max(r) OVER w AS u_right, max(m) OVER w AS u_bottom FROM r WINDOW w AS (PARTITION BY p_brand)""",
    "classified_counts": """WITH c AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS e, count(*) FILTER (WHERE l_returnflag = 'A') AS f, CAST(sum(CAST(l_quantity * 7 AS BIGINT)) AS BIGINT) AS n, count(*) - 1 AS p FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN e > 0 THEN 0.9 WHEN f > 0 THEN 0.72 WHEN n > 600 THEN 0.64 WHEN p > 0 THEN 0.55 ELSE 0.25 END::DOUBLE AS c, (n % 120)::DOUBLE AS o FROM c), m AS (SELECT *, CASE WHEN o > 1 THEN o / 100 ELSE o END AS u FROM s)
SELECT k, round(c, 6) AS confidence, c < 0.45 AS review_required, CASE n % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'acroform' ELSE CASE WHEN e > 0 THEN 'acroform' ELSE 'flat' END END AS kind, round(least(1, greatest(0, CASE WHEN u <= 0 THEN c ELSE (c + u) / 2 END)), 6) AS merged FROM m""",
    "contact_transcripts": """SELECT o_orderkey AS doc_id, unnest(['phone', 'fax', 'telephone']) AS label, unnest([concat('555-', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(10), '1', o_orderkey) ELSE '' END), o_orderstatus, concat('x', o_orderkey)]) AS value FROM orders""",
    "payload_fields": """SELECT o_orderkey AS doc_id, 'status' AS source_key, o_orderstatus AS value, (o_orderkey % 10 / 10.0)::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 'day', o_orderpriority, NULL FROM orders WHERE o_orderkey % 3 < 2""",
    "linked_forms": """WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_partkey % 50 AS x, p_partkey % 7 AS y, p_partkey % 3 AS m, least(3, p_partkey % 4) = 3 AS same FROM part)
SELECT k::VARCHAR AS sample_id, 'Name of it' AS key, CASE WHEN m = 0 THEN CASE WHEN same THEN concat(n, chr(10), b) ELSE b END WHEN m = 1 THEN n ELSE b END AS value, CASE WHEN m = 0 AND same THEN 'multiline' ELSE 'text' END AS kind,
(CASE WHEN m = 2 OR (m = 0 AND NOT same) THEN x + 100 ELSE x + 60 END)::DOUBLE AS "left", (CASE WHEN m = 2 OR (m = 0 AND NOT same) THEN y + 5 ELSE y + 3 END)::DOUBLE AS top, (CASE WHEN m = 1 THEN x + 95 ELSE x + 115 END)::DOUBLE AS "right", (CASE WHEN m = 1 THEN y + 14 ELSE y + 15 END)::DOUBLE AS bottom FROM p WHERE m <> 1 OR same
UNION ALL SELECT k::VARCHAR, n, b, 'text', (x + 100)::DOUBLE, (y + 5)::DOUBLE, (x + 115)::DOUBLE, (y + 15)::DOUBLE FROM p WHERE m = 1 AND k % 4 = 2""",
    "manifest_rows": """WITH o AS (SELECT o_orderkey AS k, concat('s', o_orderkey) AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, o_orderstatus AS st, o_orderpriority AS d FROM orders)
SELECT split, s AS sample_id, 0::BIGINT AS ord, 'status' AS key, 1 AS page_number, d AS value, 'text' AS kind FROM o WHERE k % 3 = 0 UNION ALL SELECT split, s, 1000000, 'day', 7, d, 'text' FROM o WHERE k % 3 = 0 UNION ALL SELECT split, s, 1000001, 'other', 9, st, 'text' FROM o WHERE k % 3 = 0
UNION ALL SELECT split, s, 0, 'own', CASE WHEN k % 3 = 2 AND k % 5 = 0 THEN 4 ELSE 1 END, st, 'text' FROM o WHERE k % 3 > 0""",
    "release_buckets": """WITH c AS (SELECT l_orderkey, count(*) AS n, max((l_quantity > 48)::INT) AS g, max(l_linenumber) AS p, sum(l_linenumber) AS w FROM lineitem GROUP BY 1)
SELECT CASE WHEN n * 2 <= 4 THEN 'sparse' WHEN n * 2 <= 8 THEN 'medium' ELSE 'dense' END AS density, CASE WHEN g = 1 THEN 'multiline' ELSE 'single' END AS lines, CASE WHEN p - 2 > 1 THEN 'multi_page' ELSE 'single_page' END AS pages, CASE WHEN w > n * 3 * 1.1 THEN 'landscape' WHEN n * 3 > w * 1.1 THEN 'portrait' ELSE 'squareish' END AS aspect, count(*) AS n FROM c GROUP BY ALL""",
    "value_forms": r"""WITH p AS (SELECT p_partkey AS k, p_name AS n, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN CASE WHEN length(a) >= 4 THEN concat('dr', n) ELSE concat('dr ', n) END WHEN 1 THEN CASE WHEN length(a) >= 4 THEN concat('r', n) ELSE concat('r ', n) END WHEN 2 THEN n ELSE CASE WHEN length(a) >= 4 THEN concat('j', n) ELSE concat('j ', n) END END AS person,
concat(['Dr ', 'r ', '', 'J '][k % 4 + 1], n) AS bare, ['2019', '1998', '', ''][k % 4 + 1] AS year, CASE k % 4 WHEN 2 THEN concat(n, ' 2019x') WHEN 3 THEN concat(n, ', 19') ELSE n END AS rest, CASE WHEN k % 3 = 1 THEN ['x', 'other', '[X]', '✓'][k % 4 + 1] WHEN k % 4 = 1 THEN concat(['cash', '[x]', 'card'][k % 3 + 1], ' other ', n) ELSE ['cash', '[x]', 'card'][k % 3 + 1] END AS choice, n AS station, ['phone', 'fax', 'telephone', 'mobile', 'email', 'email', 'post'][k % 7 + 1] AS label FROM p""",
    "planned_regions": """WITH r AS (SELECT l_orderkey AS d, l_linenumber AS n, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT d, n % 2 + 1 AS p, CASE WHEN q % 3 = 0 THEN concat('l', n) ELSE concat('f', n) END AS k, n = 1 AS crit, f = 'R' AS date, q % 7 <> 0 AS has, q % 4 = 0 AS blank, q / 50 AS c, (d % 10 + n % 2 + 1) / 10 >= 0.55 AS dense FROM r WHERE q % 11 <> 0),
s AS (SELECT *, NOT has OR blank AS none FROM t), g AS (SELECT d, k, p, CASE WHEN none THEN 'missing_value' WHEN c < 0.62 THEN 'low_confidence' WHEN date OR crit THEN 'critical_field' WHEN dense THEN 'dense_layout' END AS reason, CASE WHEN crit THEN 3 WHEN none THEN 3 WHEN c < 0.62 THEN 2 WHEN date THEN 1 ELSE 0 END + dense::INT AS w FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY w DESC, p, k) AS rank FROM g WHERE reason IS NOT NULL)
SELECT d AS doc_id, k AS field_key, CAST(p AS INTEGER) AS page_number, reason, CAST(w AS INTEGER) AS priority, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
    "stuck_jobs": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS step, ts, CASE WHEN event_id % 31 = 0 THEN 'failed' WHEN event_id % 31 = 1 THEN 'succeeded' WHEN event_id % 31 < 6 THEN 'running' ELSE 'step' END AS event FROM events WHERE user_id IS NOT NULL),
w AS (SELECT *, min(seq) FILTER (event IN ('failed', 'succeeded')) OVER (PARTITION BY job_id) AS fin, max(ts) OVER (PARTITION BY job_id) AS seen, max(ts) OVER () AS now FROM e),
s AS (SELECT job_id, CASE arg_max(event, seq) WHEN 'step' THEN 'running' ELSE arg_max(event, seq) END AS status, max(seq) AS last_seq, CAST(count(DISTINCT step) FILTER (event = 'step') AS INTEGER) AS steps, max(seen) AS seen, max(now) AS now FROM w WHERE fin IS NULL OR seq <= fin GROUP BY 1)
SELECT job_id, CASE WHEN status IN ('running', 'queued') AND seen + INTERVAL 1 DAY <= now THEN 'failed' ELSE status END AS status, last_seq, steps FROM s""",
}
