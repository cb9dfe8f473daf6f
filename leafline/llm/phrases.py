"""Phrase collocations by level-wise (Apriori) passes, scored by their weakest cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, stored
from .textnp import LOWER, column_bytes, mix, row_groups, words

MIN_COUNT = 10
LONGEST = 3
COVER_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
#: Parts of a language's phrases that are ranked before all of it is.
RANKED_APART = 32


class Sizes(NamedTuple):
    """What the work is cut by; none of it changes a result."""

    #: Bits of the table of frequent grams of a level, which is broadcast: 16 MB whatever the corpus.
    bits: int = 27
    #: Hashes that a task counts together before it passes them on, and bytes of text whose phrases it counts together.
    together: int = 2_000_000
    group_bytes: int = 4 << 20
    #: Bits of the hashes that are counted: enough for a gram to have one to itself in 100 TB, and a quarter less to shuffle than 64.
    counted_bits: int = 44
    #: Partitions of the input whose phrases one task counts, so that fewer partial counts of one phrase are shuffled.
    merged_partitions: int = 4
    #: A gram with this share of all words (one in so many) is joined by broadcast; there are no more of them of any length.
    hot_share: int = 1000


#: What ends a piece, and what is in a word.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAKS
IN_WORD[[0x20, 0x09]] = False

_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E6C63D0676A9A99)) | np.uint64(1)


class _Grams:
    """The words of a group of rows, and the hashes of the grams that lie within a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
        hashes, self.rows, self.starts, self.ends = words(data, offsets, IN_WORD)
        self.data = data
        self.words = mix(hashes + salts[self.rows]) if len(hashes) else hashes
        ends = np.cumsum(BREAKS[data], dtype=np.int32)
        self.joined = np.zeros(len(hashes), dtype=bool)  # to the next word
        if len(hashes) > 1:
            self.joined[:-1] = (self.rows[1:] == self.rows[:-1]) & (ends[self.starts[1:]] == ends[self.ends[:-1] - 1])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the grams of ``k`` words."""
        at = np.ones(len(self.words), dtype=bool)
        for j in range(k - 1):
            at[: len(at) - j] &= self.joined[j:]
            at[len(at) - j :] = False
        at = np.flatnonzero(at)
        if k == 1:
            return at, self.words
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            total += self.words[at + j] * _PLACES[j]
        return at, mix(total)

    def candidates(self, k: int, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The grams of ``k`` words whose two overlapping grams of a word less may both be frequent."""
        at, hashes = self.level(k)
        if k == 1 or not len(at):
            return at, hashes
        shorter, of = self.level(k - 1)
        often = np.zeros(len(self.words), dtype=bool)
        often[shorter] = _marked(tables[k - 1], of)
        keep = often[at] & often[at + 1]
        return at[keep], hashes[keep]

    def phrases(self, first: np.ndarray, k: int) -> list[bytes]:
        """The words from each place of ``first`` on, lower-cased and joined by spaces."""
        text, starts, ends = LOWER[self.data].tobytes(), self.starts, self.ends
        plain = np.ones(len(first), dtype=bool)
        for j in range(k - 1):
            plain &= (starts[first + j + 1] - ends[first + j] == 1) & (self.data[ends[first + j]] == 0x20)
        a, b = starts[first].tolist(), ends[first + k - 1].tolist()
        out = [text[x:y] for x, y in zip(a, b, strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = b" ".join(text[starts[w] : ends[w]] for w in range(first[i], first[i] + k))
        return out


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _groups(batch: pa.RecordBatch, group_bytes: int) -> Iterator[tuple[int, _Grams]]:
    """(first row, grams) of each group of rows; languages salt the hashes."""
    data, offsets = column_bytes(batch, "text")
    langs = [zlib.crc32((x.as_py() or "").encode("utf-8", "replace")) for x in batch.column(0)]
    salts = mix(np.array(langs, dtype=np.uint64) + np.uint64(1))
    for i, j in row_groups(offsets, group_bytes):
        yield i, _Grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salts[i:j])


def _frequent(texts: DataFrame, k: int, tables, least: int, sizes: Sizes) -> np.ndarray:
    """Marks of the slots of every gram of ``k`` words that comes ``least`` times or more, after pruning by the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) >> np.uint64(64 - sizes.counted_bits), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["h", "c"])

        for batch in batches:
            for _, grams in _groups(batch, sizes.group_bytes):
                held.append(grams.candidates(k, tables.value)[1])
                if sum(map(len, held)) >= sizes.together:
                    yield flush()
        if held:
            yield flush()

    often = texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    slot = F.shiftright("h", sizes.counted_bits - sizes.bits)
    bits = often.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (sizes.bits - 6), dtype=np.int64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint8)


def _counted(texts: DataFrame, longest: int, tables, sizes: Sizes) -> DataFrame:
    """lang, k, phrase, c: counts, group by group, of grams that may be frequent; with k = 0, of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, grams in _groups(batch, sizes.group_bytes):
                lang = lambda rows: batch.column(0).take(pa.array(rows + i))  # noqa: B023, E731
                rows, n = np.unique(grams.rows, return_counts=True)
                yield _rows(lang(rows), 0, [b""] * len(rows), n)
                for k in range(1, longest + 1):
                    at, hashes = grams.candidates(k, tables.value)
                    keep = _marked(tables.value[k], hashes)
                    _, first, n = np.unique(hashes[keep], return_index=True, return_counts=True)
                    first = at[keep][first]
                    yield _rows(lang(grams.rows[first]), k, grams.phrases(first, k), n)

    return texts.mapInArrow(run, "lang string, k int, phrase string, c long")


def _rows(lang: pa.Array, k: int, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "k", "phrase", "c"])


def frequent_grams(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, k, phrase, f: the phrases of 1 to ``longest`` words that a language has ``min_count`` times or more, and with k = 0 the number of its words.

    One pass a level: a gram of k words is counted only where both grams of k - 1 words that
    it overlaps may be frequent. What may be frequent is a broadcast bit table of a
    fixed size, by hashes of the grams, so a level's table has the same bound at any
    size; other grams that fall in a marked slot are counted in vain and leave by their
    exact count. The last pass counts the phrases themselves. In one pass over 4 MB of text, grams
    are told apart by 64-bit hashes.
    """
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))
    context, marks = docs.sparkSession.sparkContext, {}
    tables = context.broadcast(dict(marks))
    for k in range(1, longest + 1):
        marks[k] = _frequent(texts, k, tables, min_count, sizes)
        tables.destroy()
        tables = context.broadcast(dict(marks))
    merged = texts.coalesce(max(texts.rdd.getNumPartitions() // sizes.merged_partitions, context.defaultParallelism))
    counts = _counted(merged, longest, tables, sizes).groupBy("lang", "k", "phrase").agg(F.sum("c").alias("f"))
    out = stored(counts.where((F.col("k") == 0) | (F.col("f") >= min_count)), "phrase-grams")
    tables.destroy()
    return out


def _with_count(cuts: DataFrame, grams: DataFrame, hot: DataFrame, part: Column, name: str) -> DataFrame:
    """``cuts`` with the count of the gram ``part``. The few grams that begin or end very many phrases come by broadcast and take no part in the join by key."""
    table = lambda g, n: g.select("lang", F.col("phrase").alias("_part"), F.col("f").alias(n))
    seen = cuts.withColumn("_part", part).join(F.broadcast(table(hot, "_hot")), ["lang", "_part"], "left")
    # a line feed is in no word, so these keys match nothing and spread
    seen = seen.withColumn("_part", F.when(F.col("_hot").isNull(), F.col("_part")).otherwise(F.concat(F.lit("\n"), "phrase")))
    return seen.join(table(grams, "_cold"), ["lang", "_part"], "left").withColumn(name, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_part")


def _uncovered(phrases: DataFrame, longest: int, cover_percent: int) -> DataFrame:
    """``phrases`` without those that lie in a longer one which has at least ``cover_percent`` of their occurrences."""
    inner = [
        phrases.where(F.col("k") == k).select("lang", F.array_join(F.slice(F.split("phrase", " "), s + 1, m), " ").alias("phrase"), F.col("a").alias("longer"))
        for k in range(3, longest + 1)
        for m in range(2, k)
        for s in range(k - m + 1)
    ]
    if not inner:
        return phrases
    every = inner[0]
    for more in inner[1:]:
        every = every.unionByName(more)
    best = every.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(best, ["lang", "phrase"], "left").where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * cover_percent, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP, text_col: str = "text", lang_col: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces
    into words at spaces and tabs. A phrase that comes a times is cut after each of its words; a cut into parts
    that come l and r times scores floor(1000000 a a / (l r)) in exact decimals, and the lowest cut counts (of
    equal ones the first). A phrase is dropped if a longer one that holds it has ``cover_percent`` of its occurrences.
    Order: score and a descending, then phrase in UTF-8 byte order.

    Null languages are ``und``; null and empty texts have no words; repeated rows count
    each; other columns are ignored. An empty table gives an empty one.
    """
    grams = frequent_grams(docs, longest, min_count, text_col, lang_col, sizes)
    total = grams.where("k = 0").agg(F.sum("f")).first()[0] or 0
    hot = grams.where(F.col("k").between(1, longest - 1) & (F.col("f") * sizes.hot_share >= total))
    phrases = grams.where("k >= 2").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parts = grams.where(F.col("k").between(1, longest - 1))
    cuts = _with_count(cuts, parts, hot, F.expr("substring_index(phrase, ' ', cut)"), "l")
    cuts = _with_count(cuts, parts, hot, F.expr("substring_index(phrase, ' ', cut - k)"), "r")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("top", wide("a") * wide("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div below"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    kept = _uncovered(scored.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score"), longest, cover_percent)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    # the best of each of RANKED_APART parts first, so that the task of a language gets a bounded number of rows
    parts_ = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    best = parts_.withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top).withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    words_of = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    out = stored(best.join(words_of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    discard(grams)
    return out


def op11_query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 4) AS t(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 10
), cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, c.cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, array_to_string(w[s : s + 1], ' ') AS phrase, a FROM cand, range(1, 3) AS t(s) WHERE k = 3) GROUP BY ALL
)
SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY score DESC, a DESC, p.phrase) AS rank, p.phrase, a, l, r, n, score
FROM least p LEFT JOIN inner_ i ON i.lang = p.lang AND i.phrase = p.phrase JOIN totals t ON t.lang = p.lang
WHERE NOT coalesce(100 * i.longer >= 50 * a, FALSE)
QUALIFY rank <= 2000
"""
