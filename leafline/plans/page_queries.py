"""Queries of page detection over pages laid out from the parts table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages, petition

#: Lines of a page by kind: text (null: the part's name), left and right edge, and whether it is a mark to tick.
LINES = [
    (0, 0, "Name:", 20, 60, False), (1, 0, "Name:", 20, 60, False), (1, 1, " Age ? ", 170, 200, False), (2, 0, "Is it so?", 20, 80, False), (2, 1, " ", 100, 108, True), (2, 2, "Yes", 110, 130, False), (2, 3, " ", 140, 148, True), (2, 4, "No", 150, 165, False),
    (3, 0, " ", 40, 48, True), (3, 1, "AM", 50, 65, False), (3, 2, " ", 80, 88, True), (3, 3, "PM", 90, 105, False), (4, 0, "Report No.", 20, 90, False), (4, 1, " , 20", 120, 140, False), (5, 0, None, 20, 80, False), (6, 0, "PART NOTICE", 20, 180, False),
    (7, 0, "Describe it:", 10, 60, False), (8, 0, " ", 20, 28, True), (8, 1, None, 30, 80, False), (9, 0, "May 3, 2024", 20, 80, False), (10, 0, "Contact info:", 20, 70, False), (10, 1, " ", 190, 198, True), (10, 2, "Yes", 200, 215, False), (11, 0, "", 20, 30, False), (12, 0, "Page 3", 20, 60, False),
]
_PAGE = "p_partkey div 24 AS doc_id", "cast(p_partkey div 12 % 2 + 1 as int) AS page_number"


def _pages(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """spans and drawings: two pages of twelve lines a document."""
    part = spark.read.parquet(f"{d}/part.parquet").selectExpr(*_PAGE, "p_partkey AS k", "p_partkey % 12 AS n", "p_partkey * 31 % 13 AS kind", "p_name", "p_partkey % 12 * 22 + p_partkey * 5 % 4 AS y")
    kinds = spark.createDataFrame(LINES, "kind int, ord int, text string, l int, r int, mark boolean")
    spans = part.join(F.broadcast(kinds), "kind").selectExpr(
        "doc_id", "page_number", "n AS line", "ord", "coalesce(text, p_name) AS text", "if(mark, 'Times New Roman', 'Arial') AS font",
        "cast(l + k % 7 as double) AS left", "cast(y as double) AS top", "cast(r + k % 7 as double) AS right", "cast(y + 10 as double) AS bottom",
    )
    drawn = part.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).where("i = 0 or k % 3 = 0").selectExpr(
        "doc_id", "page_number", "k * 2 + i AS ord", "cast(60 + i * 150 + k * 37 % 120 as double) AS x0", "cast(n * 22 + k * 3 % 16 + 6 as double) AS y0",
        "cast(60 + i * 150 + k * 37 % 120 + 30 + k * 53 % 200 as double) AS x1", "cast(n * 22 + k * 3 % 16 + 6 + if(k % 5 = 0, 15, 1) as double) AS y1",
    )
    return spans, drawn


def line_answers(spark, d):
    """The labels of each line and the rules they take."""
    spans, drawn = _pages(spark, d)
    lines = pages.page_lines(spans)
    return pages.answers_of_lines(pages.rules_on_lines(lines, pages.answer_rules(drawn, lines))).drop("hint")


def page_fields(spark, d):
    """All fields of the pages, in order."""
    found = pages.detect_fields(*_pages(spark, d))
    return found.select("doc_id", "ord", "page_number", "label", "kind", "left", "top", "right", "bottom", "confidence", "hint", F.col("continuation.top").alias("c_top"), F.col("continuation.bottom").alias("c_bottom"))


#: Printed terms of petition pages by variant: first words, then each term on a line of its own.
PETITIONS = {0: ("Dilekçe Formu", [t for v, *_, terms, _k, _s, _w, _h, _c in petition.SPECS if v == petition.GENERIC for t in terms[:1]]), 1: ("TEK DERS BAŞVURU FORMU", [t for v, *_, terms, _k, _s, _w, _h, _c in petition.SPECS if v == petition.SINGLE for t in terms[-1:]])}


def petition_fields(spark, d):
    """Fields of a page a part, in turn of either variant; where a term stands, and which have a rule, depends on the part."""
    printed = [(v, 0, title) for v, (title, _) in PETITIONS.items()] + [(v, i + 1, t) for v, (_, terms) in PETITIONS.items() for i, t in enumerate(terms)]
    terms = spark.createDataFrame(printed, "variant int, line int, term string")
    part = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS doc_id", "1 AS page_number", "cast(p_partkey % 2 as int) AS variant", "p_partkey AS k")
    lines = part.join(F.broadcast(terms), "variant").withColumn("y", F.expr("line * 37 + k % 5")).withColumn("x", F.expr("30 + k * (line + 3) % 120"))
    words = lines.select("doc_id", "page_number", "line", "x", "y", F.posexplode(F.split("term", " ")).alias("i", "word")).selectExpr("doc_id", "page_number", "line * 10 + i AS ord", "word", "cast(x + i * 40 as double) AS left", "cast(y as double) AS top", "cast(x + i * 40 + 36 as double) AS right", "cast(y + 10 as double) AS bottom")
    drawn = lines.where("(k + line) % 3 > 0").selectExpr("doc_id", "page_number", "line AS ord", "cast(x + 150 as double) AS x0", "cast(y + 8 + k % 7 as double) AS y0", "cast(x + 150 + 60 + k * 7 % 300 as double) AS x1", "cast(y + 9 + k % 7 as double) AS y1")
    sizes = part.selectExpr("doc_id", "page_number", "595.0D AS width", "842.0D AS height")
    return petition.detect_petition_fields(words, drawn, sizes)


_KINDS = ", ".join("({}, {}, {}, {}, {}, {})".format(a, b, "NULL" if t is None else f"'{t}'", x, y, m) for a, b, t, x, y, m in LINES)
_ANSWERS = rf"""RECURSIVE kinds(kind, ord, text, l, r, mark) AS (VALUES {_KINDS}),
part_ AS (SELECT p_partkey // 24 AS d, p_partkey // 12 % 2 + 1 AS p, p_partkey AS k, p_partkey % 12 AS n, p_partkey * 31 % 13 AS kind, p_name, p_partkey % 12 * 22 + p_partkey * 5 % 4 AS y FROM part),
spans AS (SELECT d, p, n, ord, coalesce(text, p_name) AS text, trim(coalesce(text, p_name)) AS plain, mark, (l + k % 7)::DOUBLE AS l, y::DOUBLE AS t, (r + k % 7)::DOUBLE AS r, (y + 10)::DOUBLE AS b FROM part_ JOIN kinds USING (kind)),
lines0 AS (SELECT d, p, n, trim(regexp_replace(string_agg(text, '' ORDER BY ord), '\s+', ' ', 'g')) AS text, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, coalesce(list(l ORDER BY ord) FILTER (WHERE mark), []) AS marks, coalesce(list({{'plain': plain, 'l': l, 'r': r}} ORDER BY ord) FILTER (WHERE plain <> ''), []) AS spans FROM spans GROUP BY 1, 2, 3),
lines AS (SELECT *, CASE WHEN text = '' THEN TRUE WHEN contains(text, '20') AND contains(text, ',') THEN FALSE WHEN len(marks) > 0 AND text IN ('AM', 'PM') THEN FALSE ELSE starts_with(text, 'Page ') OR (text = upper(text) AND NOT contains(text, ':') AND NOT contains(text, '?')) END AS skip FROM lines0),
drawn AS (SELECT d, p, n, k * 2 + i AS ord, (60 + i * 150 + k * 37 % 120)::DOUBLE AS x0, (n * 22 + k * 3 % 16 + 6)::DOUBLE AS y0, (30 + k * 53 % 200)::DOUBLE AS w, CASE WHEN k % 5 = 0 THEN 15.0 ELSE 1.0 END AS h FROM part_, (VALUES (0), (1)) AS v(i) WHERE i = 0 OR k % 3 = 0),
found AS (SELECT d, p, ord, x0 AS l, greatest(0, y0 - 18)::DOUBLE AS t, x0 + w AS r, y0 + 4 AS b FROM drawn WHERE w >= 35 AND h <= 3.5
UNION ALL SELECT d, p, ord, x0, y0, x0 + w, y0 + h::DOUBLE FROM drawn a WHERE w >= 120 AND h >= 12 AND NOT EXISTS (SELECT 1 FROM lines x WHERE x.d = a.d AND x.p = a.p AND x.text <> '' AND x.text = upper(x.text) AND NOT contains(x.text, ':') AND NOT contains(x.text, '?') AND x.t >= a.y0 - 6 AND x.b <= a.y0 + a.h + 6 AND x.l >= a.x0 - 8 AND x.r <= a.x0 + a.w + 8)),
rules AS (SELECT *, row_number() OVER (PARTITION BY d, p ORDER BY t, l, ord) AS id FROM found),
near AS (SELECT x.d, x.p, x.n, list({{'id': u.id, 'l': u.l, 't': u.t, 'r': u.r, 'b': u.b}} ORDER BY u.id) AS rules FROM lines x JOIN rules u ON u.d = x.d AND u.p = x.p AND u.b >= x.t - 2 AND u.t <= x.b + 0.5 AND u.r >= x.l - 6 AND u.l <= x.r + CASE WHEN contains(x.text, ', 20') THEN 160 ELSE 80 END WHERE NOT x.skip GROUP BY 1, 2, 3),
labelled AS (SELECT x.*, rules, list_filter(spans, lambda s: s.plain NOT IN ('Yes', 'No', 'AM', 'PM') AND (ends_with(s.plain, ':') OR ends_with(s.plain, '?') OR contains(s.plain, 'No.'))) AS printed, list_concat(list_transform(list_filter(spans, lambda s: s.plain IN ('Yes', 'No', 'AM', 'PM')), lambda s: s.l), marks) AS ticks FROM lines x JOIN near USING (d, p, n)),
named AS (SELECT *, contains(text, '20') AND contains(text, ',') AS year, CASE WHEN len(printed) > 0 OR (contains(text, '20') AND contains(text, ',')) THEN printed WHEN len(marks) = 0 AND len(spans) = 1 AND length(spans[1].plain) >= 3 AND len(list_filter(rules, lambda u: u.l >= spans[1].r + 12)) > 0 THEN spans ELSE [] END AS labels FROM labelled),
fold AS (SELECT d, p, n, 0 AS i, []::BIGINT[] AS used, []::STRUCT(j BIGINT, id BIGINT, bar DOUBLE)[] AS got FROM named
UNION ALL SELECT d, p, n, i + 1, CASE WHEN ok THEN list_append(used, u.id) ELSE used END, CASE WHEN ok THEN list_append(got, {{'j': i + 1, 'id': u.id, 'bar': bar}}) ELSE got END
FROM (SELECT *, u.id IS NOT NULL AND least(u.r, bar - 6) - greatest(u.l, labels[i + 1].r + 4) >= 22 AS ok FROM
(SELECT *, list_filter(rules, lambda x: NOT list_contains(used, x.id) AND x.r > labels[i + 1].r + 8 AND x.l < bar)[1] AS u FROM
(SELECT f.*, m.labels, m.rules, coalesce(list_min(list_filter(m.ticks, lambda x: x > m.labels[f.i + 1].r + 6)), 'infinity'::DOUBLE) AS bar FROM fold f JOIN named m USING (d, p, n) WHERE f.i < len(m.labels))))),
done AS (SELECT m.*, used, got FROM named m JOIN fold f USING (d, p, n) WHERE f.i = len(m.labels)),
took AS (SELECT d, p, n, text, len(got) AS had, g.j - 1 AS place, labels[g.j].plain AS label, u.id, greatest(u.l, labels[g.j].r + 4) AS l, u.t, least(u.r, g.bar - 6) AS r, u.b, 0.80 AS confidence FROM (SELECT *, unnest(got) AS g FROM done) e, LATERAL (SELECT list_filter(e.rules, lambda x: x.id = e.g.id)[1] AS u)),
ranked AS (SELECT * REPLACE (row_number() OVER (PARTITION BY d, p, n ORDER BY place) - 1 AS place) FROM took),
lone AS (SELECT d, p, n, text, 1 AS had, 0 AS place, labels[1].plain AS label, rules[1].id AS id, greatest(rules[1].l, labels[1].r + 4) AS l, rules[1].t, rules[1].r, rules[1].b, 0.76 AS confidence FROM done WHERE len(got) = 0 AND len(rules) = 1 AND len(labels) = 1 AND rules[1].r - greatest(rules[1].l, labels[1].r + 4) >= 22),
plain_ AS (SELECT * FROM ranked UNION ALL SELECT * FROM lone),
clean AS (SELECT * REPLACE (regexp_replace(label, '(\s*[:?.,])+$', '') AS label) FROM plain_),
years0 AS (SELECT d, p, n, text, used, unnest(list_filter(rules, lambda x: NOT list_contains(used, x.id) AND x.r - x.l >= 28)) AS u FROM done WHERE len(labels) = 1 AND contains(text, ', 20')),
years AS (SELECT d, p, n, text, row_number() OVER (PARTITION BY d, p, n ORDER BY u.id) - 1 AS i, (SELECT count(*) FROM clean c WHERE c.d = y.d AND c.p = y.p AND c.n = y.n) AS before, u FROM years0 y),
alone AS (SELECT d, p, n, text, list_sort(list_transform(rules, lambda x: {{'far': x.r < r + 6, 'gap': abs(x.l - r), 'id': x.id, 'u': x}}))[1].u AS u FROM done WHERE len(labels) = 0 AND year),
answers AS (SELECT d, p, n, text, place, label, l, t, r, b, confidence FROM clean
UNION ALL SELECT d, p, n, text, before + i, CASE WHEN i = 0 THEN 'Report Year' ELSE 'Report Year 2' END, u.l, u.t, u.r, u.b, 0.66 FROM years
UNION ALL SELECT d, p, n, text, 0, 'Report Year', u.l, u.t, u.r, u.b, 0.72 FROM alone)"""

SQL = {
    "line_answers": f"""WITH {_ANSWERS}
SELECT d AS doc_id, CAST(p AS INTEGER) AS page_number, n AS ord, CAST(place AS INTEGER) AS place, label, l AS "left", t AS top, r AS "right", b AS bottom, CAST(confidence AS DOUBLE) AS confidence FROM answers""",
    "page_fields": f"""WITH {_ANSWERS},
long AS (SELECT a.*, u.id, u.l AS ul, u.t AS ut, u.r AS ur, u.b AS ub FROM answers a JOIN rules u ON u.d = a.d AND u.p = a.p AND u.l <= a.l + 10 AND u.r >= a.r - 10 AND (u.t + u.b) / 2 > (a.t + a.b) / 2 + 8 AND u.t - a.b <= 60 WHERE contains(lower(label), 'describe') OR contains(lower(label), 'contact info')),
open AS (SELECT *, row_number() OVER (PARTITION BY d, p, n, place ORDER BY ut, id) AS rn FROM long g WHERE NOT EXISTS (SELECT 1 FROM lines x WHERE x.d = g.d AND x.p = g.p AND x.n > g.n AND NOT x.skip AND x.t <= g.ub + 6 AND x.b >= g.ut - 6 AND NOT EXISTS (SELECT 1 FROM lines y WHERE y.d = g.d AND y.p = g.p AND y.n > g.n AND y.n < x.n AND y.t > g.ub + 6))),
more AS (SELECT d, p, n, place, min(ut) AS c_top, max(ub) AS c_bottom FROM open WHERE rn <= 2 GROUP BY ALL),
context AS (SELECT x.d, x.p, x.n, max(CASE WHEN ends_with(y.text, '?') THEN y.n END) AS q, max(CASE WHEN ends_with(y.text, ':') THEN y.n END) AS c FROM lines x JOIN lines y ON y.d = x.d AND y.p = x.p AND y.n < x.n AND NOT y.skip GROUP BY ALL),
above AS (SELECT x.d, x.p, x.n, any_value(y.text) FILTER (WHERE y.n = c.q AND (SELECT min(z.b) FROM lines z WHERE z.d = x.d AND z.p = x.p AND z.n >= c.q AND z.n < x.n) >= x.t - 35) AS asked, any_value(y.text) FILTER (WHERE y.n = c.c AND (SELECT min(z.b) FROM lines z WHERE z.d = x.d AND z.p = x.p AND z.n >= c.c AND z.n < x.n) >= x.t - 35) AS labelled
FROM lines x JOIN context c USING (d, p, n) JOIN lines y ON y.d = x.d AND y.p = x.p AND (y.n = c.q OR y.n = c.c) GROUP BY ALL),
ticked AS (SELECT x.*, coalesce(list_filter(spans, lambda s: ends_with(s.plain, '?'))[1].plain, asked) AS question, coalesce(list_filter(spans, lambda s: ends_with(s.plain, ':') OR ends_with(s.plain, '?') OR contains(s.plain, 'No.'))[-1].plain, labelled) AS label, unnest(range(1, len(marks) + 1)) AS i FROM lines x LEFT JOIN above USING (d, p, n) WHERE NOT skip),
options AS (SELECT *, marks[i] AS m, list_filter(spans, lambda s: s.l > marks[i] + 1)[1].plain AS o FROM ticked),
ticks AS (SELECT d, p, n, text, i - 1 AS place, CASE WHEN o IN ('Yes', 'No') AND question IS NOT NULL THEN concat(regexp_replace(question, '(\\s*[:?.,])+$', ''), ' ', o) WHEN o IN ('AM', 'PM') AND label IS NOT NULL THEN concat(regexp_replace(label, '(\\s*[:?.,])+$', ''), ' ', o) ELSE concat(regexp_replace(o, '(\\s*[:?.,])+$', ''), ' Selected') END AS label, greatest(0, m - 10.5)::DOUBLE AS l, t + 0.5 AS t, m + 1.0 AS r, t + 11.5 AS b, 0.78 AS confidence FROM options WHERE o IS NOT NULL),
every AS (SELECT a.*, CASE WHEN c_top IS NULL THEN 'text' ELSE 'multiline' END AS kind, 0 AS branch, c_top, c_bottom FROM answers a LEFT JOIN more USING (d, p, n, place) UNION ALL SELECT *, 'checkbox', 1, NULL, NULL FROM ticks),
first AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY d, p, kind, label, round_even(l, 0), round_even(t, 0), round_even(r, 0), round_even(b, 0) ORDER BY n, branch, place) = 1)
SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY p, n, branch, place) AS INTEGER) AS ord, CAST(p AS INTEGER) AS page_number, label, kind, l AS "left", t AS top, r AS "right", b AS bottom, CAST(confidence AS DOUBLE) AS confidence, text AS hint, c_top, c_bottom FROM first""",
}

_SPEC_ROWS = ", ".join("('{}', {}, '{}', '{}', '{}', '{}', '{}', {}, {}, {})".format(v, i, part, label, t.replace("'", "''"), kind, way, w, h, conf) for i, (v, part, label, terms, kind, way, w, h, conf) in enumerate(petition.SPECS) for t in terms)
_TERM_ROWS = ", ".join("({}, {}, '{}')".format(v, i, t.replace("'", "''")) for v, (title, terms) in PETITIONS.items() for i, t in enumerate([title, *terms]))
_FIXED_ROWS = ", ".join("({}, '{}', '{}', {}, {}, {}, {})".format(len(petition.SPECS) + 1 + i, *x) for i, x in enumerate(petition.FIXED))
SQL["petition_fields"] = f"""WITH terms(v, line, term) AS (VALUES {_TERM_ROWS}), specs(variant, rank, part, label, term, kind, way, mw, h, confidence) AS (VALUES {_SPEC_ROWS}), fixed(rank, label, kind, l, t, r, b) AS (VALUES {_FIXED_ROWS}),
lines AS (SELECT p_partkey AS d, p_partkey AS k, CASE WHEN v = 1 THEN '{petition.SINGLE}' ELSE '{petition.GENERIC}' END AS variant, line, term, line * 37 + p_partkey % 5 AS y, 30 + p_partkey * (line + 3) % 120 AS x FROM part JOIN terms ON v = p_partkey % 2),
words AS (SELECT d, variant, line, x, y, string_split(lower(term), ' ') AS w FROM lines),
asked AS (SELECT DISTINCT variant, rank, part, label, lower(term) AS term, string_split(lower(term), ' ') AS a FROM specs),
hits AS (SELECT d, s.rank, s.term, s.part, s.label, x + (i - 1) * 40 AS l, y AS t, x + (i + len(a) - 2) * 40 + 36 AS r, y + 10 AS b, line * 10 + i AS ord
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words) g JOIN asked s ON s.variant = g.variant AND i + len(a) - 1 <= len(w) AND CASE WHEN len(a) = 1 THEN contains(w[i], a[1]) ELSE ends_with(w[i], a[1]) AND starts_with(w[i + len(a) - 1], a[len(a)]) AND w[i + 1 : i + len(a) - 2] = a[2 : len(a) - 1] END
WHERE NOT (s.variant = '{petition.SINGLE}' AND s.label = 'tarih') OR y <= {petition.DATE_ABOVE}),
first AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY d, rank, term ORDER BY ord) = 1),
anchor AS (SELECT a.d, a.l, a.t, a.r, a.b, s.* EXCLUDE (term) FROM (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY d, rank ORDER BY t, l) = 1) a JOIN (SELECT DISTINCT ON (rank) * FROM specs) s USING (rank)),
rules AS (SELECT d, line AS id, (x + 150)::DOUBLE AS l, greatest(0, y + 8 + k % 7 - 18)::DOUBLE AS t, (x + 210 + k * 7 % 300)::DOUBLE AS r, (y + 14 + k % 7)::DOUBLE AS b FROM lines WHERE (k + line) % 3 > 0 AND 60 + k * 7 % 300 >= 70),
near AS (SELECT a.d, a.rank, u.l, u.t, u.r FROM anchor a JOIN rules u ON u.d = a.d AND u.r - u.l >= a.mw AND CASE way WHEN 'underline_right' THEN u.b >= a.t - 8 AND u.t <= a.b + 18 AND u.l >= a.r - 10 WHEN 'underline_below' THEN u.t >= a.b - 6 AND u.t <= a.b + 38 AND u.r >= a.l + 40 ELSE u.b >= a.t - 28 AND u.t <= a.b + 10 AND u.l >= a.l - 10 END
WHERE part IN ('anchor', 'contact') QUALIFY row_number() OVER (PARTITION BY a.d, a.rank ORDER BY abs(u.t - a.b), abs(u.l - a.r), u.t, u.l) = 1),
boxed AS (SELECT a.d, a.variant, a.rank, a.part, a.label, a.kind, a.confidence, n.l IS NOT NULL AS ruled, coalesce(n.l, CASE way WHEN 'underline_below' THEN a.l WHEN 'underline_above' THEN a.r + 8 ELSE a.r + 10 END) AS l, CASE way WHEN 'underline_below' THEN a.b + 8 WHEN 'underline_above' THEN a.t - 4 ELSE a.t - 2 END AS high, greatest(0, coalesce(n.t + 1, high)) AS t, n.r AS nr, a.mw, a.h FROM anchor a LEFT JOIN near n USING (d, rank) WHERE part IN ('anchor', 'contact')),
chosen AS (SELECT * EXCLUDE (nr, mw, h, high, ruled), coalesce(nr, least(595.0 - 24, l + mw)) AS r, CASE WHEN ruled THEN least(841.0, t + h) ELSE least(818.0, high + h) END AS b FROM boxed WHERE ruled OR least(571.0, l + mw) - l >= 40),
contact AS (SELECT *, l + (r - l) * 0.46::DOUBLE AS split FROM chosen WHERE part = 'contact'),
free AS (SELECT d, rank, label, kind, confidence, l, t, r, b FROM chosen WHERE part = 'anchor' UNION ALL SELECT d, rank, label, kind, confidence, l, t, greatest(l + 70, split - 4), t + 16 FROM contact UNION ALL SELECT d, rank + 1, 'e_posta', kind, 0.88, least(r - 110, split + 4), t, r, t + 16 FROM contact),
ends AS (SELECT d, label, t - 12 AS till FROM anchor WHERE part = 'end'),
every AS (SELECT * FROM free UNION ALL SELECT d, rank, label, kind, confidence, greatest(l - 18, 0), b + 8, r + 18, b + 44 FROM anchor WHERE part = 'cell' UNION ALL SELECT d, rank, label, kind, confidence, r + 6, t - 2, least(523, r + 260), b + 10 FROM anchor WHERE part = 'signature'
UNION ALL SELECT a.d, rank, a.label, kind, confidence, 70, b + 12, 525, coalesce(till, least(802, b + 180)) FROM anchor a LEFT JOIN ends USING (d, label) WHERE part = 'section' AND coalesce(till, least(802, b + 180)) - (b + 12) >= 40
UNION ALL SELECT p_partkey, f.rank, f.label, f.kind, 0.90, f.l, f.t, f.r, f.b FROM part, fixed f WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM free x WHERE x.d = p_partkey AND x.label = f.label)),
kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY d, label, kind, round_even(l::DOUBLE, 0), round_even(t::DOUBLE, 0), round_even(r::DOUBLE, 0), round_even(b::DOUBLE, 0) ORDER BY rank) = 1)
SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY rank) AS INTEGER) AS ord, 1 AS page_number, CASE WHEN d % 2 = 1 THEN '{petition.SINGLE}' ELSE '{petition.GENERIC}' END AS variant, label, kind, l::DOUBLE AS "left", t::DOUBLE AS top, r::DOUBLE AS "right", b::DOUBLE AS bottom, confidence::DOUBLE AS confidence FROM kept"""

QUERIES = {f.__name__: f for f in (line_answers, page_fields, petition_fields)}
