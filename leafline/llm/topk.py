"""Exact top-k inner-product search with Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole doubles; null if the vector can take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


#: Scores below this are exact as doubles, whatever the order of their sums; score columns are 64 bits wide.
EXACT, LONG = 2.0**53, 1 << 63


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _whole(vectors: pd.Series, width: int) -> np.ndarray:
    """The same as whole numbers of any size."""
    out = np.full((len(vectors), width), 0, dtype=object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v]
    return out


def threshold_topk(ids: np.ndarray, items: np.ndarray, query: np.ndarray, skip: int | None, k: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best of ``items`` for one query.

    ``lists[:, j]`` holds the positions in ascending order of component j; it is
    walked from the end where the query's component is positive, from the start
    where it is negative. Depth doubles from step to step. After each step the
    bound on any unseen item is the query times the components last reached; the
    walk ends when the k-th score is above it. An unseen item that ties with
    the bound could still win by its id, so an equal bound does not end the walk.
    """
    n = len(items)
    used = np.flatnonzero(query)
    seen = np.zeros(n, dtype=bool)
    scores = np.zeros(0, dtype=items.dtype)
    at = np.zeros(0, dtype=np.int64)
    depth, done = min(32, n), 0
    if not len(used):
        depth = n
        seen[:] = True
    up = used[query[used] > 0]
    down = used[query[used] < 0]
    while True:
        if len(used):
            before = seen.copy()
            seen[lists[n - depth : n - done, up]] = True
            seen[lists[done:depth, down]] = True
            fresh = np.flatnonzero(seen & ~before)
        else:
            fresh = np.flatnonzero(seen)
        if skip is not None:
            fresh = fresh[ids[fresh] != skip]
        at = np.concatenate((at, fresh))
        scores = np.concatenate((scores, items[fresh] @ query))
        if len(at) > k:
            kth = sorted(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            at, scores = at[keep], scores[keep]
        if depth >= n:
            break
        if len(at) >= k:
            bound = query[up] @ items[lists[n - depth, up], up] + query[down] @ items[lists[depth - 1, down], down]
            if scores.min() > bound:
                break
        done, depth = depth, min(n, depth * 2)
    best = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k] if scores.dtype == object else np.lexsort((ids[at], -scores))[:k]
    return at[best], scores[best]


def exact_topk(queries: DataFrame, items: DataFrame, id_col: str, vector_col: str, k: int = 5, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k items with the largest inner product for each query, ties to the smaller id.

    ``queries`` and ``items`` have an integer id and an array of whole numbers
    (null: takes no part). An item with the query's own id is not its candidate.
    Items are dealt into blocks by a hash of the id and queries likewise; each
    pair of blocks is one task group of bounded size, in which every query
    runs the threshold algorithm over the block's sorted component lists. The
    best k of each block meet in a window whose limit Spark applies before its
    shuffle. Shorter vectors count as padded with zeros. Rows with a repeated id
    are separate candidates; null ids take no part; no items gives no rows. A block in which
    a score may pass 2 ** 53 is worked in whole numbers of any size, which is slower and as exact; a score that
    64 bits can't hold is given as the nearest that they can, and ranks by what it is within its block.
    Other columns of the inputs are ignored.

    Returns query_id long, rank int, item_id long, score long.
    """
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    c = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    n_q, n_c = q.count(), c.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))
    left = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def block(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        rows = {"query_id": [], "item_id": [], "score": []}
        if len(qs) and len(cs):
            width = max(1, int(qs.v.map(len).max()), int(cs.v.map(len).max()))
            query, item = _matrix(qs.v, width), _matrix(cs.v, width)
            if np.abs(query).max() * np.abs(item).max() * width >= EXACT:
                query, item = _whole(qs.v, width), _whole(cs.v, width)
            ids, lists = cs.id.to_numpy(), np.argsort(item, axis=0, kind="stable")
            for own, row in zip(qs.id.to_numpy(), query, strict=True):
                at, scores = threshold_topk(ids, item, row, int(own), k, lists)
                rows["query_id"] += [own] * len(at)
                rows["item_id"] += ids[at].tolist()
                rows["score"] += [min(max(int(x), -LONG), LONG - 1) for x in scores]
        return pd.DataFrame(rows)

    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(block, "query_id long, item_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def op3_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v"))
    found = exact_topk(rows.where(F.col("vec_id") % 50 == 0), rows, "vec_id", "v", k=5)
    return found.select("query_id", "rank", F.col("item_id").alias("vec_id"), "score")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
