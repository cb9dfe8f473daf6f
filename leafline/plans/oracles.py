"""SQL for the queries of ``queries``, in a dialect with QUALIFY-free windows and RE2 patterns."""

from __future__ import annotations

from ..functions import confidence, text
from ..operators import identity
from .queries import NORM


def norm(x: str) -> str:
    return NORM.format(x)


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(plain, '{w}') AS INTEGER)" for w in words)


_CASES = """
docs AS (
  SELECT doc_id AS sample_id, source, lang, coalesce(n_chars, 0) AS n,
         CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS BIGINT) AS h FROM documents
), e AS (
  SELECT sample_id, 0 AS ord, 'Source' AS key, source AS v, 'text' AS kind FROM docs
  UNION ALL SELECT sample_id, 1, 'Long text', CASE WHEN n > 1000 THEN 'Yes' ELSE 'No' END, 'checkbox' FROM docs
  UNION ALL SELECT sample_id, 2, 'Language', lang, 'text' FROM docs
), p AS (
  SELECT sample_id, 'source' AS key, CASE WHEN h % 5 = 0 THEN source || 'x' ELSE upper(source) END AS v, h / 100.0::DOUBLE AS c FROM docs
  UNION ALL SELECT sample_id, 'long text', CASE WHEN h % 7 = 0 THEN '' WHEN n > 1000 THEN 'checked' ELSE 'off' END, 1 - h / 200.0::DOUBLE FROM docs
  UNION ALL SELECT sample_id, CASE WHEN h % 4 = 0 THEN 'tongue' ELSE 'language' END, lang, 0.5::DOUBLE FROM docs
), sc AS (
  SELECT e.sample_id, e.key, e.v AS expected_value, coalesce(p.v, '') AS predicted_value, coalesce(p.c, 0.0) AS confidence,
         CASE WHEN e.kind = 'checkbox' THEN CASE lower(e.v) WHEN 'yes' THEN 'true' ELSE 'false' END = CASE coalesce(p.v, '') WHEN 'checked' THEN 'true' WHEN 'off' THEN 'false' ELSE '' END
              ELSE @A = @B END AS matched,
         coalesce(p.v, '') <> '' AS covered
  FROM e LEFT JOIN p ON e.sample_id = p.sample_id AND lower(e.key) = p.key
), st AS (
  SELECT *, CASE WHEN matched THEN 'matched' WHEN NOT covered THEN 'missing' ELSE 'mismatch' END AS status FROM sc
)""".replace("@A", norm("e.v")).replace("@B", norm("coalesce(p.v, '')"))

_SAMPLES = "s AS (SELECT o_orderkey AS sample_id, o_orderkey % 101 / 100.0::DOUBLE AS match_rate, o_orderkey % 37 / 36.0::DOUBLE AS coverage, o_orderkey % 53 / 52.0::DOUBLE AS confidence FROM orders)"
_BOXES = "b AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_partkey AS k, CAST(p_partkey * 37 % 500 AS DOUBLE) AS l, CAST(p_partkey * 91 % 700 AS DOUBLE) AS t, CAST(p_partkey * 37 % 500 + 20 + p_partkey % 90 AS DOUBLE) AS r, CAST(p_partkey * 91 % 700 + 6 + p_partkey % 40 AS DOUBLE) AS m FROM part)"
_BUCKET = "CASE WHEN confidence >= 0.8 AND confidence < 1.01 THEN '0.8-1.0' WHEN confidence >= 0.6 AND confidence < 0.8 THEN '0.6-0.8' WHEN confidence >= 0.4 AND confidence < 0.6 THEN '0.4-0.6' WHEN confidence >= 0.2 AND confidence < 0.4 THEN '0.2-0.4' ELSE '0.0-0.2' END"
_PRIOR = "CASE l_linenumber % 4 WHEN 0 THEN 0.99 WHEN 1 THEN 0.82 WHEN 2 THEN 0.70 ELSE 0.78 END"
_LANG = f"CASE WHEN ({_hits(identity.TURKISH)}) >= 4 AND ({_hits(identity.ENGLISH)}) >= 4 THEN 'mixed' WHEN ({_hits(identity.TURKISH)}) > ({_hits(identity.ENGLISH)}) AND ({_hits(identity.TURKISH)}) >= 2 THEN 'tr' WHEN ({_hits(identity.ENGLISH)}) > ({_hits(identity.TURKISH)}) AND ({_hits(identity.ENGLISH)}) >= 2 THEN 'en' ELSE 'unknown' END"
_FAMILY = f"CASE WHEN plain = '' THEN 'unknown' WHEN ({_hits(identity.PETITION)}) >= 3 THEN 'student_petition' WHEN ({_hits(identity.INSURANCE)}) >= 3 THEN 'insurance_incident' WHEN ({_hits(['consent', 'acik riza', 'onay formu'])}) > 0 THEN 'consent_form' WHEN ({_hits(['claim', 'basvuru', 'application'])}) > 0 THEN 'application_form' ELSE 'generic_form' END"

SQL = {
    "norm_text": f"SELECT doc_id, md5({norm('text')}) AS norm FROM documents",
    "slugify_names": f"SELECT p_partkey, coalesce(nullif(replace({norm('p_name')}, ' ', '_'), ''), 'field') AS slug, TRUE AND coalesce(nullif(replace({norm('p_name')}, ' ', '_'), ''), 'field') = lower(replace(p_name, ' ', '_')) AND NOT regexp_matches(lower(replace(p_name, ' ', '_')), '{text.GENERIC_NAME}') AS semantic FROM part",
    "contact_extract": rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '{text.EMAIL}', 1), '|') AS emails, array_to_string(regexp_extract_all(text, '(\+?[0-9][0-9()\-\s]{{6,}}[0-9])', 1), '|') AS phones FROM documents",
    "year_canonical": "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "station_address": f"""WITH s AS (SELECT s_suppkey, string_split({norm("'Police Station PS ' || s_name || ' ' || s_name || ' Illiwas peit'")}, ' ') AS w FROM supplier),
k AS (SELECT s_suppkey, w, list_filter(w, lambda t: NOT list_contains(['police','station','ps','form','no','w','b','p','s','year','at'], t) AND NOT regexp_full_match(t, '[0-9]+')) AS f FROM s)
SELECT s_suppkey, array_to_string(list_filter(f, lambda t, i: i = 1 OR t <> f[i - 1]), ' ') AS station,
array_to_string(list_transform(w, lambda t: CASE t WHEN 'illiwas' THEN 'illinois' WHEN 'peit' THEN 'pe17' ELSE t END), ' ') AS address FROM k""",
    "field_scores": f"WITH {_CASES} SELECT sample_id, key, expected_value, predicted_value, round(confidence, 6) AS confidence, matched, covered, status FROM st",
    "field_scoring_report": f"""WITH {_CASES}, per AS (SELECT sample_id, bool_and(matched) AS success FROM st GROUP BY 1),
a AS (SELECT avg(CAST(matched AS DOUBLE)) AS m, avg(CAST(covered AS DOUBLE)) AS c FROM st), b AS (SELECT avg(CAST(success AS DOUBLE)) AS s FROM per), x AS (SELECT avg(h / 100.0::DOUBLE) AS mc, avg(CAST(h % 3 = 0 AS DOUBLE)) AS rr FROM docs)
SELECT round(m, 6) AS field_match, round(c, 6) AS field_coverage, round(s, 6) AS document_success, round(mc, 6) AS mean_confidence, round(rr, 6) AS review_rate FROM a, b, x""",
    "calibration": f"WITH {_CASES}, g AS (SELECT {_BUCKET} AS bucket, count(*) AS n, avg(CAST(matched AS DOUBLE)) AS r FROM st GROUP BY 1) SELECT v.bucket, coalesce(n, 0) AS fields, round(coalesce(r, 0.0), 6) AS match_rate FROM (SELECT unnest({confidence.BUCKETS!r}) AS bucket) v LEFT JOIN g ON v.bucket = g.bucket",
    "issue_counts": f"WITH {_CASES} SELECT 'benchmark.missing_field' AS code, count(*) AS n FROM st WHERE status = 'missing' HAVING count(*) > 0 UNION ALL SELECT 'benchmark.unexpected_field', count(*) FROM p WHERE key = 'tongue' HAVING count(*) > 0",
    "worst_k": f"WITH {_SAMPLES} SELECT sample_id, round(match_rate, 6) AS match_rate FROM s ORDER BY s.match_rate, confidence, sample_id LIMIT 10",
    "showcase_slots": f"""WITH {_SAMPLES}, g AS (SELECT 'good' AS slot, sample_id FROM s ORDER BY match_rate DESC, coverage DESC, confidence DESC, sample_id LIMIT 1), h AS (SELECT 'hard' AS slot, sample_id FROM s ORDER BY match_rate, coverage, confidence, sample_id LIMIT 1),
m AS (SELECT 'borderline' AS slot, sample_id FROM s WHERE sample_id NOT IN (SELECT sample_id FROM g UNION ALL SELECT sample_id FROM h) ORDER BY abs(match_rate - 0.5), confidence, sample_id LIMIT 1) SELECT * FROM g UNION ALL SELECT * FROM h UNION ALL SELECT * FROM m""",
    "hash_split": "SELECT doc_id, CAST((('0x' || md5(source || ':' || CAST(doc_id AS VARCHAR)))::UHUGEINT) % 10 AS INTEGER) AS tenth FROM documents",
    "stratified_subset": "WITH d AS (SELECT doc_id, lang || '/' || CASE WHEN n_chars <= 500 THEN 'sparse' WHEN n_chars <= 3000 THEN 'medium' ELSE 'dense' END AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM d) SELECT doc_id, bucket FROM r ORDER BY rn, bucket, doc_id LIMIT 50",
    "gates": """WITH m AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'fir' ELSE 'funsd_plus' END AS dataset, avg(CAST(l_quantity > 10 AS DOUBLE)) AS a, avg(CAST(l_discount < 0.1 AS DOUBLE)) AS b FROM lineitem GROUP BY 1),
u AS (SELECT dataset, 'field_normalized_exact_match' AS metric, a AS actual FROM m UNION ALL SELECT dataset, 'field_coverage', b FROM m), g(dataset, metric, least) AS (VALUES ('funsd_plus', 'field_normalized_exact_match', 0.90::DOUBLE), ('funsd_plus', 'field_coverage', 0.98), ('fir', 'field_normalized_exact_match', 0.72), ('fir', 'field_coverage', 0.88))
SELECT dataset, metric, round(actual, 6) AS actual, CAST(g.least AS DOUBLE) AS "least", actual >= g.least AS passed FROM u JOIN g USING (dataset, metric)""",
    "review_queue": f"WITH {_CASES} SELECT lang AS dataset, st.sample_id, key AS field, CASE WHEN key = 'Source' AND l.doc_id IS NOT NULL THEN 'ocr_confusion_risk' ELSE status END AS reason FROM st JOIN docs USING (sample_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = st.sample_id WHERE NOT matched",
    "region_plan": """WITH t AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS field_key, l_linenumber % 2 + 1 AS page_number, min(CASE WHEN l_returnflag = 'R' THEN 'date' ELSE 'text' END) AS kind, min(CASE WHEN l_quantity < 5 THEN '' ELSE 'x' END) AS value, min(l_quantity / 50) AS confidence, max(l_tax) AS density FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN value = '' THEN 'missing_value' WHEN confidence < 0.62 THEN 'low_confidence' WHEN kind = 'date' OR field_key = 'f1' THEN 'critical_field' WHEN density >= 0.55 THEN 'dense_layout' END AS reason, greatest(CASE WHEN value = '' THEN 3 WHEN confidence < 0.62 THEN 2 WHEN kind = 'date' THEN 1 ELSE 0 END, CASE WHEN field_key = 'f1' THEN 3 ELSE 0 END) + CAST(density >= 0.55 AS INTEGER) AS priority FROM t)
SELECT * FROM (SELECT doc_id, field_key, reason, priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, page_number, field_key) AS rank FROM p WHERE reason IS NOT NULL) WHERE rank <= 3""",
    "first_wins_dedup": "SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "last_wins_dedup": "SELECT user_id, event_type, max(event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "coalesce_segments": "SELECT conv_id AS doc_id, 'text' AS key, md5(string_agg(text, chr(10) ORDER BY turn)) AS value FROM conversations WHERE text <> '' GROUP BY 1",
    "family_resolution": """WITH o AS (SELECT user_id AS doc_id, event_type AS key, min(event_id) AS ord, count(*) % 2 = 0 AS selected, round(max(value), 3) AS confidence FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY selected DESC, confidence DESC, ord) AS rn, count(*) FILTER (selected) OVER (PARTITION BY doc_id) AS n, min(confidence) FILTER (confidence > 0) OVER (PARTITION BY doc_id) AS low FROM o)
SELECT doc_id, 'kind' AS family, ord, key, CASE WHEN selected AND rn = 1 THEN 'yes' ELSE '' END AS value, coalesce(low, confidence) AS confidence, CASE WHEN NOT (selected AND rn = 1) THEN 'expected_empty' WHEN n > 1 THEN 'field_family_conflict' ELSE '' END AS reason FROM r""",
    "best_candidate": "SELECT user_id, arg_max(event_type, k) AS value, CAST(max(k[1]) AS DOUBLE) AS confidence FROM (SELECT *, [event_id % 11, length(event_type), -event_id] AS k FROM events) GROUP BY 1",
    "nearest_context": """WITH e AS (SELECT *, epoch_us(ts) AS tt, event_type = (SELECT min(event_type) FROM events) AS rare FROM events),
c AS (SELECT event_id, tt, max(CASE WHEN rare THEN [tt, event_id] END) OVER (PARTITION BY user_id ORDER BY tt, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e) SELECT event_id, CASE WHEN tt - k[1] <= 3600000000 THEN CAST(k[2] AS VARCHAR) END AS context FROM c""",
    "box_overlap": f"""WITH {_BOXES}, p AS (SELECT x.doc_id, CAST(x.k AS VARCHAR) AS a, CAST(y.k AS VARCHAR) AS b, greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.m, y.m) - greatest(x.t, y.t)) AS i, (x.r - x.l) * (x.m - x.t) + (y.r - y.l) * (y.m - y.t) AS s FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.k < y.k)
SELECT doc_id, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) > 0.04""",
    "box_distance": f"""WITH {_BOXES} SELECT CAST(x.k AS VARCHAR) AS name, round(least(sqrt(pow((x.l + x.r - y.l - y.r) / 2, 2) + pow((x.t + x.m - y.t - y.m) / 2, 2)) / greatest(sqrt(pow(x.r - x.l, 2) + pow(x.m - x.t, 2)), 1.0), 1.0), 6) AS distance,
CAST(round_even(least(greatest((x.m - x.t) * CASE WHEN x.k % 2 = 0 THEN 0.68 ELSE 0.75 END, 6.0), 12.0), 1) AS DOUBLE) AS size FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.k - 1 = x.k""",
    "routing_strategy": "SELECT conv_id AS doc_id, max(length(text)) AS max_chars, min(length(text)) AS min_chars, CASE WHEN max(length(text)) >= 50 AND min(length(text)) >= 20 THEN 'structure_first' WHEN max(length(text)) < 20 THEN 'vision_first' ELSE 'hybrid' END AS strategy FROM conversations GROUP BY 1",
    "text_density": r"SELECT conv_id AS doc_id, turn AS page_number, round(least(1.0::DOUBLE, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) / 1200.0::DOUBLE), 6) AS density FROM conversations",
    "keyword_identity": f"WITH d AS (SELECT doc_id, {norm('text')} AS plain FROM documents), f AS (SELECT *, {_FAMILY} AS family FROM d) SELECT doc_id, {_hits(identity.TURKISH)} AS turkish_words, {_hits(identity.ENGLISH)} AS english_words, {_LANG} AS language, family, CASE WHEN family = 'student_petition' OR ({_hits(['universite', 'faculty', 'fakulte', 'student affairs'])}) > 0 THEN 'education' WHEN family = 'insurance_incident' THEN 'insurance' WHEN family = 'consent_form' OR contains(plain, 'employee') THEN 'hr' WHEN family = 'application_form' THEN 'operations' ELSE 'unknown' END AS domain FROM f",
    "code_lookup": f"SELECT n_nationkey, coalesce(replace({norm('r_name')}, ' ', '_'), 'generic') AS profile FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "confidence_derive": f"WITH c AS (SELECT l_orderkey, CASE WHEN l_quantity < 3 THEN 0.0 ELSE greatest(0.0, {_PRIOR} - CASE WHEN l_tax > 0.04 THEN 0.26 ELSE 0.0 END)::DOUBLE END AS c FROM lineitem) SELECT l_orderkey, round(avg(c), 6) AS mean, round(coalesce(avg(c) FILTER (c > 0), 0.0), 6) AS mean_positive FROM c GROUP BY 1",
    "job_state": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS step, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 17 = 1 THEN 'succeeded' WHEN event_id % 17 < 6 THEN 'running' ELSE 'step' END AS event FROM events),
w AS (SELECT *, min(seq) FILTER (event IN ('failed', 'succeeded')) OVER (PARTITION BY job_id) AS fin FROM e)
SELECT job_id, CASE arg_max(event, seq) WHEN 'step' THEN 'running' ELSE arg_max(event, seq) END AS status, max(seq) AS last_seq, CAST(count(DISTINCT step) FILTER (event = 'step') AS INTEGER) AS steps FROM w WHERE fin IS NULL OR seq <= fin GROUP BY 1""",
}

SQL |= {
    "verification": """WITH f AS (SELECT user_id AS doc_id, event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS a, CASE WHEN event_id % 5 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS b FROM events),
g AS (SELECT doc_id, avg(a) AS s, avg(b) AS o, count(*) AS n, count(*) FILTER (a < 0.72 OR b < 0.72) AS weak, coalesce(string_agg('f' || event_id, ',' ORDER BY 'f' || event_id) FILTER (event_id IN (5, 11) AND (a < 0.648 OR b < 0.648)), '') AS c FROM f GROUP BY 1)
SELECT doc_id, round(s, 6) AS source, round(o, 6) AS output, round(((s + o) / 2 + 0.9::DOUBLE) / 2 * 0.92::DOUBLE, 6) AS overall, weak, c AS critical_failures, s >= 0.72 AND o >= 0.72 AND weak <= greatest(1, n // 4) AND c = '' AS passed FROM g""",
    "borrowed_values": "WITH v AS (SELECT user_id AS doc_id, event_id, event_type FROM events WHERE event_id % 5 = 0), t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, event_type) AS n FROM v) SELECT doc_id, CAST(event_id AS VARCHAR) AS source_key FROM t WHERE n > 1",
}

SQL |= {
    "unique_slugs": f"""WITH s AS (SELECT p_brand, p_partkey, coalesce(nullif(replace({norm('p_type')}, ' ', '_'), ''), 'field') AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, s ORDER BY p_partkey) AS rn FROM s)
SELECT p_brand, p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '_' || rn END AS name FROM r""",
    "preferred_value": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, CAST(event_id % 11 / 10.0 AS DOUBLE) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id AS ord, event_type AS value, c AS confidence FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, CASE WHEN t.takes THEN e.event_id ELSE f.ord END, CASE WHEN t.takes THEN e.event_type ELSE f.value END, CASE WHEN t.takes THEN e.c ELSE f.confidence END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1,
LATERAL (SELECT CASE WHEN abs(e.c - f.confidence) > 0.05 THEN e.c > f.confidence ELSE length(e.event_type) >= length(f.value) END AS takes) t)
SELECT user_id, arg_max(ord, rn) AS ord, arg_max(value, rn) AS value, arg_max(confidence, rn) AS confidence FROM f GROUP BY 1""",
    "box_assign": f"""WITH RECURSIVE {_BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM b),
pairs AS (SELECT x.doc_id, x.i, y.k AS t, greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.m, y.m) - greatest(x.t, y.t)) AS o, (x.r - x.l) * (x.m - x.t) + (y.r - y.l) * (y.m - y.t) AS s, least(sqrt(pow((x.l + x.r - y.l - y.r) / 2, 2) + pow((x.t + x.m - y.t - y.m) / 2, 2)) / greatest(sqrt(pow(x.r - x.l, 2) + pow(x.m - x.t, 2)), 1.0), 1.0) AS far FROM n x JOIN n y ON x.doc_id = y.doc_id),
scored AS (SELECT doc_id, i, t, o / (s - o) * 0.7 + (1 - far) * 0.3 AS score FROM pairs), lists AS (SELECT doc_id, i, list({{'t': t, 'score': score}} ORDER BY score DESC, t) FILTER (WHERE score > 0) AS c FROM scored GROUP BY ALL),
taken AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS t, NULL::DOUBLE AS score FROM n UNION ALL SELECT doc_id, i, CASE WHEN p.t IS NULL THEN used ELSE list_append(used, p.t) END, p.t, p.score FROM (SELECT k.doc_id, l.i, k.used, list_filter(l.c, lambda x: NOT list_contains(k.used, x.t))[1] AS p FROM taken k JOIN lists l ON l.doc_id = k.doc_id AND l.i = k.i + 1))
SELECT n.doc_id, concat('d', n.k) AS source_key, coalesce(g.t::VARCHAR, '') AS target_field, round(coalesce((score + 0.9) / 2, 0)::DOUBLE, 6) AS confidence, CASE WHEN g.t IS NULL THEN 'unmapped' WHEN score >= 0.35 THEN 'mapped' ELSE 'needs_review' END AS status FROM n JOIN taken g ON g.doc_id = n.doc_id AND g.i = n.i""",
    # what each rule makes of the query's values: labels and trailing words go, a misread domain, station, year and statutes are repaired
    "rule_pipeline": """WITH d AS (SELECT doc_id, source, n_chars % 100 AS n, lpad((n_chars % 100)::VARCHAR, 2, '0') AS two FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, ['Phone', 'E-mail', 'Police Station', 'Year', 'Statutes'][i] AS source_key, [concat('0532 123 45', two), concat(source, '@samplemail.com'), 'Airport', CAST(CASE WHEN n < 40 THEN 2000 + n ELSE 1900 + n END AS VARCHAR), '341/325/307/506/34'][i] AS value,
0.8::DOUBLE AS confidence, 'rule_compound' AS source_kind, CASE WHEN i > 2 THEN 'ocr_confusion_risk' ELSE '' END AS review_reasons FROM d, range(1, 6) AS t(i)""",
}
