"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnp import ALNUM, column_bytes, row_groups, words

WINDOW = 10
#: Bytes of benchmark text that one pass broadcasts at most; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20


class TestItems:
    """Words of benchmark items as numbers of a sorted vocabulary; 0 ends an item."""

    def __init__(self, ids: list, texts: list[str], window: int):
        data, offsets = column_bytes(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), "t")
        hashes, rows, _, _ = words(data, offsets, ALNUM)
        self.vocabulary = np.unique(hashes)
        counts = np.bincount(rows, minlength=len(ids))
        begins = np.cumsum(counts + 1) - (counts + 1)
        self.seq = np.zeros(int((counts + 1).sum()), dtype=np.int64)
        self.seq[np.arange(len(hashes)) + rows] = np.searchsorted(self.vocabulary, hashes) + 1
        size = np.minimum(counts, window)
        starts, need, item = [], [], []
        for k in np.flatnonzero(counts):
            n = int(counts[k] - size[k] + 1)
            starts.append(begins[k] + np.arange(n))
            need.append(np.full(n, size[k]))
            item.append(np.full(n, k))
        empty = np.zeros(0, np.int64)
        self.starts, self.need, self.item = (np.concatenate(x) if x else empty for x in (starts, need, item))
        self.ids = ids
        self.longest = int(counts.max()) if len(counts) else 0
        self.least = int(self.need.min()) if len(self.need) else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` in the order of the next ``depth`` numbers, by prefix doubling."""
    _, rank = np.unique(seq, return_inverse=True)
    k = 1
    while k < depth and len(seq):
        ahead = np.zeros(len(seq), dtype=np.int64)
        ahead[:-k] = rank[k:] + 1
        keys, rank = np.unique(rank * (len(seq) + 1) + ahead, return_inverse=True)
        if len(keys) == len(seq):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def _common(text: np.ndarray, at: np.ndarray, test: np.ndarray, of: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from ``at`` of the text and ``of`` of the test on, ``most`` at most; a 0 matches nothing."""
    n = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    step = 0
    while len(open_):
        open_ = open_[(step < most[open_]) & (at[open_] + step < len(text))]
        same = (text[at[open_] + step] == test[of[open_] + step]) & (test[of[open_] + step] > 0)
        open_ = open_[same]
        n[open_] += 1
        step += 1
    return n


def _bounds(text: np.ndarray, order: np.ndarray, items: TestItems, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first suffix of the text not below (above) each."""
    lo, hi = np.zeros(len(items.starts), np.int64), np.full(len(items.starts), len(order))
    padded = np.append(text, 0)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        n = _common(text, order[mid], items.seq, items.starts[live], items.need[live])
        whole = n == items.need[live]
        a = padded[np.minimum(order[mid] + n, len(text))]
        b = items.seq[items.starts[live] + np.minimum(n, items.need[live] - 1)]
        right = np.where(whole, upper, a < b)
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def _search(hashes: np.ndarray, rows: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word position, item, position in the item, length) of every occurrence of a window, with the length of the verbatim match from there."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(hashes) or not len(items.starts):
        return none
    number = np.searchsorted(items.vocabulary, hashes)
    number[number == len(items.vocabulary)] = 0
    known = items.vocabulary[number] == hashes
    # stretches of benchmark words in one row, long enough to hold a window
    edge = np.ones(len(hashes), dtype=bool)
    edge[1:] = (rows[1:] != rows[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(hashes)))
    keep = known[first] & (length >= items.least)
    first, length = first[keep], length[keep]
    if not len(first):
        return none
    at = np.repeat(first - np.concatenate(([0], np.cumsum(length + 1)[:-1])), length + 1) + np.arange(int((length + 1).sum()))
    ends = np.cumsum(length + 1) - 1
    text = np.zeros(len(at), dtype=np.int64)
    inner = np.ones(len(at), dtype=bool)
    inner[ends] = False
    text[inner] = number[at[inner]] + 1
    order = suffix_array(text, items.longest)
    lo, hi = _bounds(text, order, items, False), _bounds(text, order, items, True)
    found = hi - lo
    which = np.repeat(np.arange(len(found)), found)
    place = order[np.repeat(lo - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(len(which))]
    long = _common(text, place, items.seq, items.starts[which], np.full(len(which), items.longest))
    return at[place], items.item[which], items.starts[which], long


_MATCH = pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_OWN = "n_words long, hits array<struct<start:int,end:int>>, matches array<struct<item_id:bigint,item_start:int,start:int,length:int>>, items array<bigint>"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits, matches and items.

    Words are the runs of ASCII letters and digits and of all characters above 7F, A-Z
    lower-cased. Each group of rows is a shard: a suffix array of its words is built (of the
    stretches of benchmark words that can hold a window; no match crosses the
    others), and every suffix of every item is looked up in it by binary search.
    ``matches`` are the longest verbatim matches of ``window`` words or more (of a
    shorter item: all of it) that can't be extended to the left, with item and
    word positions from 0; ``hits`` are the word intervals they cover, merged; ``items``
    the distinct item_ids, sorted.

    A benchmark beyond ``block_bytes`` is broadcast in several blocks, each in
    a pass of its own over the same rows, without a shuffle. Null texts and items have no words; items with
    null item_id are left out; repeated rows and items count like any; other columns pass
    through (those with the names of the four results are replaced). Empty tables give no matches.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = docs.drop("n_words", "hits", "matches", "items")
    plain = out.schema
    full = T.StructType([*plain.fields, *T._parse_datatype_string(_OWN).fields])
    for k in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text").toArrow()
        block = TestItems(mine["item_id"].to_pylist(), mine["text"].to_pylist(), window)
        out = out.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(block), len(plain.fields)), full)
    return out


def _pass(shared, n_plain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch, "text")
            before = batch.num_columns > n_plain
            for i, j in row_groups(offsets):
                hashes, rows, _, _ = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                n = j - i
                begins = np.searchsorted(rows, np.arange(n + 1))
                at, item, of, long = _search(hashes, rows, items)
                matches, hits, ids = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                if before:
                    matches = batch.column(n_plain + 2).slice(i, n).to_pylist()
                if len(at):
                    # a match is left-maximal if the words before it differ
                    follows = set(zip(at.tolist(), of.tolist(), strict=True))
                    for a, k, o, size in zip(at.tolist(), item.tolist(), of.tolist(), long.tolist(), strict=True):
                        if (a - 1, o - 1) not in follows:
                            r = int(rows[a])
                            first = int(items.starts[np.searchsorted(items.item, k)])
                            matches[r].append({"item_id": items.ids[k], "item_start": o - first, "start": a - int(begins[r]), "length": size})
                for r in range(n):
                    if matches[r]:
                        spans: list[list[int]] = []
                        for a, b in sorted((m["start"], m["start"] + m["length"]) for m in matches[r]):
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], b)
                            else:
                                spans.append([a, b])
                        hits[r] = [{"start": a, "end": b} for a, b in spans]
                        ids[r] = sorted({m["item_id"] for m in matches[r]})
                own = [pa.array(np.diff(begins), pa.int64()), pa.array(hits, pa.list_(_SPAN)), pa.array(matches, pa.list_(_MATCH)), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in range(n_plain)), *own], names=[*batch.schema.names[:n_plain], "n_words", "hits", "matches", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with their own columns."""
    return find_overlaps(docs, benchmark, window).where(F.size("items") == 0).select(*docs.columns)


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), x AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d
), m AS (
  SELECT p.doc_id, p.s, x.n, x.item_id FROM (SELECT DISTINCT n FROM x) z, p, x
  WHERE x.n = z.n AND p.s + z.n - 1 <= len(p.w) AND list_slice(p.w, p.s, p.s + z.n - 1) = x.g
), h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
