"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

LEVELS_A_JOB = 6


def token_count(text: Column) -> Column:
    """Words of the whole text, and one end-of-document token; null has no words."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1).cast("long")


def _probe(shares: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """alpha -> (entropy over log of the number of sources, sum of p ** alpha), one job for all of them."""
    at = shares.select("lp", F.explode(F.array(*map(F.lit, alphas))).alias("a"))
    sums = at.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("a") * F.col("lp")).alias("s"))
    return {r.a: (1.0 if r.n < 2 else (math.log(r.z) - r.s / r.z) / math.log(r.n), r.z) for r in sums.collect()}


def fit_alpha(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, low: float = 0.0, high: float = 1.0, steps: int = 36) -> float:
    """The exponent by bisection of [low, high].

    ``target_entropy``: share of the largest possible entropy that the weights
    must reach; entropy falls as the exponent grows, so this looks for the
    largest exponent that reaches it. ``max_repetition``: how many times a source
    may be repeated when the least repeated one is read once; repetition falls as
    the exponent grows, so this looks for the smallest exponent that keeps to
    it. With both, the repetition limit wins. A job evaluates all midpoints of the
    next six levels of the bisection over the table of sources, which stays in Spark.
    """
    spread = shares.agg(F.min("lp").alias("least"), F.max("lp").alias("most")).first()
    if spread.least is None:
        return high

    def bisect(good) -> tuple[float, float]:
        lo, hi = low, high
        for _ in range(0, steps, LEVELS_A_JOB):
            width = (hi - lo) / (1 << LEVELS_A_JOB)
            grid = [lo + width * i for i in range(1, 1 << LEVELS_A_JOB)]
            values = good(grid)
            i, j = 0, len(grid) + 1
            while j - i > 1:
                m = (i + j) // 2
                i, j = (m, j) if values[m - 1] else (i, m)
            lo, hi = lo + width * i, lo + width * j
        return lo, hi

    alpha = high
    if target_entropy is not None and _probe(shares, [high])[high][0] < target_entropy:

        def enough(grid):
            found = _probe(shares, grid)
            return [found[a][0] >= target_entropy for a in grid]

        alpha = bisect(enough)[0]
    if max_repetition is not None:
        repeats = lambda a: math.exp((a - 1.0) * (spread.least - spread.most))
        if repeats(alpha if target_entropy is not None else low) > max_repetition:
            alpha = bisect(lambda grid: [repeats(a) > max_repetition for a in grid])[1]
        elif target_entropy is None:
            alpha = low
    return alpha


def source_weights(docs: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> DataFrame:
    """source, tokens, weight, epochs: weights add up to 1; epochs is budget * weight / tokens.

    ``budget``: tokens to draw as a multiple of the corpus; None draws the least
    amount that reads every source once at least.
    """
    totals = stored(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-sources")
    whole = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")).first()
    shares = totals.select("source", "tokens", F.log(F.col("tokens") / F.lit(float(whole.t or 1))).alias("lp"))
    alpha = fit_alpha(shares, target_entropy, max_repetition)
    z = (_probe(shares, [alpha]).get(alpha) or (1.0, 1.0))[1]
    weights = shares.withColumn("weight", F.exp(F.lit(alpha) * F.col("lp")) / F.lit(z))
    if budget is None:
        top = math.log((whole.most or 1) / (whole.t or 1))
        drawn = (whole.t or 0) * math.exp(top) / (math.exp(alpha * top) / z)
    else:
        drawn = (whole.t or 0) * budget
    return weights.select("source", "tokens", F.lit(alpha).alias("alpha"), F.round("weight", 12).alias("weight"), F.round(F.lit(float(drawn)) * F.col("weight") / F.col("tokens"), 9).alias("epochs"))


def block_of(doc_id: Column, seed: int, blocks: int) -> Column:
    """A block from 0 to blocks - 1 by a digest of the id, alike in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")


def draw_blocks(docs: DataFrame, weights: DataFrame, seed: int = 7, blocks: int = 4096) -> DataFrame:
    """source, block, epoch, position: the blocks that each source's budget buys.

    A source is cut into at most ``blocks`` blocks by a digest of the document id,
    so a source with a third of all rows is cut as finely as any other and no
    window holds more than ``blocks`` rows. Each epoch is a permutation of the
    source's blocks of its own. Whole epochs take every block; the last takes the
    blocks whose middle lies within the part of an epoch that is left over, which
    comes within half a block of the budget. ``position`` is the part of the
    source's budget that is spent before the block: ordering by it interleaves the
    sources in their target proportions at every point of the sequence.
    """
    sizes = docs.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    per = sizes.withColumnRenamed("source", "s").join(weights, F.col("s").eqNullSafe(weights.source)).drop("s")
    per = per.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil("epochs").cast("int")) - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col("block")))
    w = Window.partitionBy("source", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("block_tokens").over(w)
    middle = (upto - F.col("block_tokens") / 2) / F.col("tokens") + F.col("epoch")
    return per.withColumn("middle", middle).where(F.col("middle") <= F.col("epochs")).select("source", "block", "epoch", "weight", (F.col("middle") / F.col("epochs")).alias("position"))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, seed: int = 7, blocks: int = 4096) -> DataFrame:
    """``docs`` drawn to the weights of temperature mixing; a row for each draw.

    Source token shares p become weights p ** alpha, normalised; alpha is bisected
    to reach ``target_entropy`` or keep to ``max_repetition``. Added columns:
    mix_epoch int (0: first reading), mix_weight double, mix_position double (order of
    the training sequence). With ``budget`` None every document is drawn once
    at least. Null sources are one source; a null or empty text counts one token;
    repeated rows are drawn alike, together; an empty table gives an empty table. Other columns
    pass through, except that those named mix_tokens, mix_block, mix_epoch,
    mix_weight and mix_position are replaced.
    """
    own = ("mix_tokens", "mix_block", "mix_epoch", "mix_weight", "mix_position", "mix_source")
    docs = docs.drop(*own)
    sized = docs.select(F.col("source"), token_count(F.col("text")).alias("tokens"), block_of(F.col("doc_id"), seed, blocks).alias("block"))
    cells = stored(sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    weights = source_weights(cells, target_entropy, max_repetition, budget)
    drawn = draw_blocks(cells, weights, seed, blocks).select(F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), F.col("epoch").alias("mix_epoch"), F.col("weight").alias("mix_weight"), F.col("position").alias("mix_position"))
    marked = docs.withColumn("mix_block", block_of(F.col("doc_id"), seed, blocks))
    return marked.join(drawn, F.col("source").eqNullSafe(F.col("mix_source")) & (marked["mix_block"] == drawn["mix_block"])).drop(marked["mix_block"]).drop("mix_source", "mix_block")


#: Production setting: 0.995 of the largest entropy, one reading of each document at least, three at most.
OP1 = {"target_entropy": 0.995, "max_repetition": 3.0}


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix_sources(docs, **OP1)
    return out.select("doc_id", "source", token_count(F.col("text")).alias("tokens"), F.col("mix_epoch").alias("epoch"), F.round("mix_weight", 6).alias("weight"), F.round("mix_position", 6).alias("position"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) + 1 AS BIGINT) AS tokens,
         CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS block
  FROM documents
), t AS (
  SELECT source, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source
), p AS (
  SELECT source, tokens, ln(tokens / (SELECT sum(tokens) FROM t)) AS lp FROM t
), h AS (
  SELECT 0 AS step, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT h.step, h.lo, h.hi,
          (SELECT (ln(sum(exp((h.lo + h.hi) / 2 * lp))) - sum(exp((h.lo + h.hi) / 2 * lp) * ((h.lo + h.hi) / 2) * lp) / sum(exp((h.lo + h.hi) / 2 * lp))) / ln(count(*)) FROM p) >= 0.995 AS ok
        FROM h WHERE h.step < 36)
), e AS (
  SELECT CASE WHEN (SELECT (ln(sum(exp(lp))) - sum(exp(lp) * lp) / sum(exp(lp))) / ln(count(*)) FROM p) >= 0.995 THEN 1.0
              ELSE (SELECT lo FROM h WHERE step = 36) END AS a0,
         (SELECT min(lp) - max(lp) FROM p) AS spread
), a AS (
  SELECT CASE WHEN exp((a0 - 1.0) * spread) > 3.0 THEN 1.0 + ln(3.0) / spread ELSE a0 END AS alpha FROM e
), w AS (
  SELECT source, tokens, exp(alpha * lp) / (SELECT sum(exp(alpha * lp)) FROM p) AS weight,
         exp((alpha - 1) * (lp - (SELECT max(lp) FROM p))) AS epochs
  FROM p, a
), c AS (
  SELECT source, block, CAST(sum(tokens) AS DOUBLE) AS block_tokens FROM d GROUP BY source, block
), x AS (
  SELECT c.source, c.block, c.block_tokens, w.tokens, w.weight, round(w.epochs, 9) AS epochs,
         CAST(unnest(range(0, CAST(greatest(1, ceil(round(w.epochs, 9))) AS BIGINT))) AS INTEGER) AS epoch
  FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source
), m AS (
  SELECT *, (sum(block_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('7:' || epoch || ':' || block), block ROWS UNBOUNDED PRECEDING) - block_tokens / 2) / tokens + epoch AS middle FROM x
)
SELECT d.doc_id, d.source, d.tokens, m.epoch, round(m.weight, 6) AS weight, round(m.middle / m.epochs, 6) AS position
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.block = m.block WHERE m.middle <= m.epochs
"""
