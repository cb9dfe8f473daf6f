"""Secret scans through a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if ``group`` of it has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, then those that the scan adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Strings that a stretch of a pattern is spelled out to at most.
SPELLINGS = 64


def _spellings(node) -> set[str] | None:
    """All strings that one parsed item can be, or None if they are too many."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value)}
    if op is sre.IN:
        out = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                out.add(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < SPELLINGS:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.BRANCH:
        parts = [_joined(x) for x in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is sre.SUBPATTERN:
        return _joined(value[-1])
    if op is sre.MAX_REPEAT and value[1] <= 3:
        one = _joined(value[2])
        if one is None:
            return None
        out, run = set(), {""}
        for n in range(value[1] + 1):
            if n >= value[0]:
                out |= run
            run = {a + b for a in run for b in one}
        return out if len(out) <= SPELLINGS else None
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _spellings(node)
        if more is None or len(out) * len(more) > SPELLINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, all of one of which every match holds (lower-cased); None if no trigram is mandatory.

    The pattern is a sequence of items. Neighbouring items with few spellings are joined
    into a stretch; a match holds one spelling of every stretch, so it holds that
    spelling's trigrams. A stretch with a spelling of under three characters asks for nothing.
    """
    stretches, run = [], {""}
    for node in sre_parser.parse(pattern):
        more = _spellings(node)
        if more is not None and len(run) * len(more) <= SPELLINGS:
            run = {a + b for a in run for b in more}
        else:
            stretches.append(run)
            run = more if more is not None else {""}
    query: set[frozenset[str]] = {frozenset()}
    for run in [*stretches, run]:
        ors = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(ors):
            query = {a | b for a in query for b in ors}
    query = {a for a in query if not any(b < a for b in query)}
    return None if frozenset() in query else sorted(query, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: a row (trigram, id) for each of ``trigrams`` that a lower-cased text holds.

    The texts are read once, into whole numbers with a bit for each trigram; these are
    written before they are spread into postings, so that no later step looks at a text again.
    """
    low = F.lower(text_col)
    masks = []
    for at in range(0, len(trigrams), 60):
        mask = F.lit(0).cast("long")
        for k, t in enumerate(trigrams[at : at + 60]):
            mask = mask + F.when(F.contains(low, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        masks.append(mask.alias(f"m{at // 60}"))
    marks = stored(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *masks), "trigram-marks")
    held = F.array_compact(F.array(*[F.when(F.col(f"m{k // 60}").bitwiseAND(F.lit(1 << (k % 60))) != 0, F.lit(t)) for k, t in enumerate(trigrams)]))
    return marks.select(F.explode(held).alias("trigram"), "id").distinct()


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """id, rules array<string>: the rules whose trigram query the postings of each id satisfy."""
    asked = sorted({t for q in queries.values() for s in q for t in s})
    held = index.where(F.col("trigram").isin(asked)).groupBy("id").agg(F.collect_set("trigram").alias("held"))
    some = lambda q: F.exists(F.array(*[F.array(*map(F.lit, sorted(s))) for s in q]), lambda s: F.size(F.array_except(s, F.col("held"))) == 0)
    met = held.select("id", F.array_compact(F.array(*[F.when(some(q), F.lit(k)) for k, q in queries.items()])).alias("rules"))
    return met.where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches in code points, end exclusive.

    Matches come leftmost first and don't overlap, so each is the first occurrence of its
    own characters after the one before: an earlier occurrence would have matched itself.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    none = F.array().cast(kind)

    def step(state: Column, m: Column) -> Column:
        start = F.position(m["m"], text, state["next"])
        return F.struct((start + F.length(m["m"])).alias("next"), F.concat(state["out"], F.when(F.length(m["g"]) >= rule.least, F.array(F.struct((start - 1).alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (start - 1 + F.length(m["m"])).alias("end"))).cast(kind)).otherwise(none)).alias("out"))

    if rule.group:
        pairs = F.zip_with(whole, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda a, b: F.struct(a.alias("m"), b.alias("g")))
    else:
        pairs = F.transform(whole, lambda a: F.struct(a.alias("m"), a.alias("g")))
    return F.aggregate(pairs, F.struct(F.lit(1).alias("next"), none.alias("out")), step, lambda s: s["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<start, rank, kind, end>> of each row, in order of start, then rule.

    Each rule's pattern yields a Boolean trigram query. The postings of the trigrams asked for
    are intersected to candidate ids, and only their texts are matched against
    the rule; a rule without a mandatory trigram is matched against all texts. Rows with a
    null id aren't in the index and are matched against every rule. Null and empty texts have no spans;
    repeated rows each have their own; whole texts are read; other columns are ignored.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    asked = sorted({t for q in queries.values() for s in q for t in s})
    index = stored(build_index(docs, asked, id_col, text_col), "trigram-index")
    found = candidates(index, queries)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(found, F.col("doc") == F.col("id"), "left")
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    own = []
    for k, rule in enumerate(rules):
        every = spans_of(F.col("text"), rule, k)
        own.append(F.when(F.array_contains("rules", rule.kind) | F.col("doc").isNull(), every).otherwise(F.array().cast(kind)) if rule.kind in queries else every)
    return rows.select(F.col("doc").alias("id"), F.array_sort(F.concat(*own)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(F.col("id").alias("doc_id"), *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    rules = BASE + ADDED
    matched = " UNION ALL ".join(
        f"SELECT doc_id, text, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}') AS ms, "
        f"regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group}) AS gs FROM d"
        for k, r in enumerate(rules)
    )
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) {0}, '')"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT * FROM ({matched}) WHERE len(ms) > 0
), r AS (
  SELECT doc_id, text, rank, kind, least, ms, gs, 0 AS i, CAST(1 AS BIGINT) AS nxt, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM m
  UNION ALL
  SELECT doc_id, text, rank, kind, least, ms, gs, i + 1, nxt + instr(substr(text, nxt), ms[i + 1]) - 1 + length(ms[i + 1]),
         nxt + instr(substr(text, nxt), ms[i + 1]) - 2, nxt + instr(substr(text, nxt), ms[i + 1]) - 2 + length(ms[i + 1])
  FROM r WHERE i < len(ms)
), f AS (
  SELECT doc_id, rank, kind, s, e FROM r WHERE i > 0 AND length(gs[i]) >= least
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         {listed.format("FILTER (rank < 3)")} AS base, {listed.format("")} AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP7_SQL = _sql()
