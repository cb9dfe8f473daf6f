"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

CHUNK = 64
PART = 256
#: Wrapping of one rendered message (fixed values).
OPEN, CLOSE = "<|", "<|end|>\n"


def _halves(digest: Column) -> list[Column]:
    """Four 32-bit whole numbers from a hex digest."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, chunk, pos (from 1, gapless within a conversation).

    A conversation is numbered by a two-level count: rows are numbered within
    chunks of ``CHUNK`` turn numbers, then chunks are offset by the rows before
    them, so no task ever holds a whole conversation.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").groupBy("conv_id", "turn", "role", "text").count().drop("count")
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit((1 << 62))))
    local = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    return _offset(turns.withColumn("pos", F.row_number().over(local).cast("long")), ["pos"])


def _offset(rows: DataFrame, running: list[str]) -> DataFrame:
    """Turns running values within chunks into running values within conversations."""
    ends = rows.groupBy("conv_id", "chunk").agg(*[F.max(c).alias(f"{c}_end") for c in running])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "chunk", *[F.coalesce(F.sum(f"{c}_end").over(before), F.lit(0)).alias(f"{c}_before") for c in running])
    out = rows.join(ends, ["conv_id", "chunk"])
    return out.select(*[(F.col(c) + F.col(f"{c}_before")).alias(c) if c in running else F.col(c) for c in rows.columns])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds h1..h4: the rolling hash of the conversation up to and with this turn.

    A turn's digest covers its position, role and text; the rolling hash is the
    running sum of the digests' four 32-bit words, kept modulo 2 ** 32. As the position is
    hashed too, two prefixes have equal sums only if they hold equal turns in equal order.
    """
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.md5(F.concat_ws("|", F.col("pos"), part(F.col("role")), part(F.col("text"))))
    names = ["h1", "h2", "h3", "h4"]
    local = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumn("digest", digest).withColumns({n: h for n, h in zip(names, _halves(F.col("digest")), strict=True)}).drop("digest")
    rows = rows.withColumns({n: F.sum(n).over(local) for n in names})
    rows = _offset(rows, names)
    return rows.withColumns({n: F.pmod(F.col(n), F.lit(1 << 32)) for n in names})


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that prefixes no longer one.

    Of conversations with equal turns the smallest conv_id stays and n_copies counts
    them all. Rows with null conv_id belong to no conversation and are left out; rows equal
    in conv_id, turn, role and text count once; rows of one turn number are
    ordered by role, then text; null turn numbers come last. Null and empty text
    differ. Extra columns are ignored; an empty table gives an empty table.
    """
    return _collapse(stored(prefix_hashes(numbered_turns(conversations)).select("conv_id", "pos", "h1", "h2", "h3", "h4"), "chat-prefixes"))


def _collapse(prefixes: DataFrame) -> DataFrame:
    ends = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = prefixes.join(ends, "conv_id")
    key = ["pos", "h1", "h2", "h3", "h4"]
    whole = marked.where("pos = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = marked.where("pos < n_turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: the maximal conversations as chat text.

    A message is ``<|role|>``, a line end, its text, ``<|end|>`` and a line end; null role
    reads ``unknown`` and null text as empty. A conversation of up to ``part`` messages is
    one row with part 0; a longer one is a row for each ``part`` messages, whose
    concatenation in order of ``part`` is the whole, so that no row grows without bound.
    """
    turns = stored(numbered_turns(conversations), "chat-turns")
    prefixes = stored(prefix_hashes(turns).select("conv_id", "pos", "h1", "h2", "h3", "h4"), "chat-prefixes")
    kept = turns.join(_collapse(prefixes), "conv_id")
    message = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = kept.select("conv_id", "n_turns", "n_copies", F.floor((F.col("pos") - 1) / part).cast("int").alias("part"), F.struct("pos", message.alias("m")).alias("x"))
    grouped = rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("conv_id", "part", "n_turns", "n_copies", F.concat_ws("", F.transform("xs", lambda x: x["m"])).alias("rendered"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH u AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos FROM u
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seq
  FROM t
), k AS (
  SELECT md5(CAST(seq AS VARCHAR)) AS h, pos, n_turns, conv_id FROM p
), w AS (
  SELECT pos, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM k WHERE pos = n_turns GROUP BY pos, h
), m AS (
  SELECT w.conv_id, w.pos AS n_turns, w.n_copies FROM w
  WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pos < k.n_turns AND k.pos = w.pos AND k.h = w.h)
)
SELECT m.conv_id, CAST((t.pos - 1) // 256 AS INTEGER) AS part, m.n_turns, m.n_copies,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM m JOIN t USING (conv_id) GROUP BY ALL
"""
