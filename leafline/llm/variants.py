"""Spelling variants: distance-one Levenshtein automata of all words against broadcast trie shards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is so many times as frequent as its variant at least.
RATIO = 5
#: One run in so many, by a hash of document and run, loses a letter.
SLIPS = 199

#: Letters of words: a-z, and U+00C0 to U+00FF as they are. 0 ends a word.
ALPHABET = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_CODES = np.zeros(256, dtype=np.uint8)
_CODES[ALPHABET] = np.arange(1, len(ALPHABET) + 1)
_LETTERS = np.array([0, *ALPHABET], dtype=np.uint8)


class Sizes(NamedTuple):
    """What the work is cut by; none of it changes a result."""

    #: Bytes of a shard, about, and of the shards that one pass broadcasts.
    shard_bytes: int = 12 << 20
    pass_bytes: int = 48 << 20
    #: Words whose automata run together, and words of a task.
    together: int = 4096
    task_words: int = 16_384


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of words of ``LEAST_LENGTH`` code points or more that come ``LEAST_COUNT`` times or more.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where the unsigned
    crc32 of ``<id>:<run>`` is divisible by ``SLIPS``, the run loses the code point at that number
    modulo its length. A null id reads as empty; null and empty texts have no words.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a shorter run can't give a word
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers, each word closed by a 0, and where each begins."""
    data = _CODES[np.frombuffer("\0".join([*words, ""]).encode("latin-1"), dtype=np.uint8)]
    ends = np.flatnonzero(data == 0)
    return data, np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)


class Trie(NamedTuple):
    """A trie of sorted words. Nodes that several words pass have edges; from where a word is alone, its node is a place in ``data``.

    Numbers below ``len(first)`` are nodes with edges, others places. A node's edges lie in order of letter;
    ``masks`` has a bit for each letter, 64 to a half, and ``first`` the first edge of each half.
    """

    data: np.ndarray
    starts: np.ndarray
    n: np.ndarray
    masks: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    children: np.ndarray


def build_trie(words: list[str], n: list[int]) -> Trie:
    """The trie of distinct words in code-point order with their counts, made level by level."""
    data, starts = encoded(words)
    member, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    ends, edge_node, labels, children = [], [], [], []
    base, nodes, depth = 0, 1, 0  # this level's nodes are base to nodes
    while len(member):
        # all members share a node with others here
        letter = data[starts[member] + depth]
        here = np.full(nodes - base, -1, dtype=np.int64)
        done = letter == 0
        here[node[done] - base] = member[done]
        ends.append(here)
        member, node, letter = member[~done], node[~done], letter[~done]
        if not len(member):
            break
        new = np.ones(len(member), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(member)))
        shared = size > 1
        to = -1 - (starts[member[at]] + depth + 1)  # a place
        to[shared] = nodes + np.arange(int(shared.sum()))
        edge_node.append(node[at])
        labels.append(letter[at])
        children.append(to)
        keep = np.repeat(shared, size)
        base, nodes = nodes, nodes + int(shared.sum())
        node = np.repeat(to, size)[keep]
        member = member[keep]
        depth += 1
    empty = np.zeros(0, np.int64)
    of, labels, children = (np.concatenate(x) if x else empty for x in (edge_node, labels, children))
    children = np.where(children < 0, nodes - 1 - children, children)
    bit = labels.astype(np.int64) - 1
    masks, first = np.zeros((nodes, 2), dtype=np.uint64), np.zeros((nodes, 2), dtype=np.int64)
    np.bitwise_or.at(masks, (of, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    counts = np.bincount(of * 2 + (bit >> 6), minlength=2 * nodes)
    first[:] = (np.cumsum(counts) - counts).reshape(nodes, 2)
    return Trie(data, starts, np.array(n, dtype=np.int64), masks, first, np.concatenate(ends) if ends else np.full(1, -1), labels.astype(np.uint8), children)


def _follow(trie: Trie, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The child of each node by a letter, -1 if it has none."""
    out = np.full(len(node), -1, dtype=np.int64)
    nodes = len(trie.first)
    place = node >= nodes
    alone = np.flatnonzero(place)
    at = node[alone]
    out[alone] = np.where(trie.data[at - nodes] == letter[alone], at + 1, -1)
    several = np.flatnonzero(~place)
    at, bit = node[several], letter[several].astype(np.int64) - 1
    half, bit = bit >> 6, (bit & 63).astype(np.uint64)
    mask = trie.masks[at, half]
    slot = trie.first[at, half] + np.bitwise_count(mask & ((np.uint64(1) << bit) - np.uint64(1)))
    has = (mask >> bit) & np.uint64(1) == 1
    out[several[has]] = trie.children[slot[has]]
    return out


def _word_at(trie: Trie, node: np.ndarray) -> np.ndarray:
    """The word that ends at each node, -1 if none does."""
    nodes = len(trie.first)
    out = np.full(len(node), -1, dtype=np.int64)
    alone = node >= nodes
    at = node[alone] - nodes
    out[alone] = np.where(trie.data[at] == 0, np.searchsorted(trie.starts, at, "right") - 1, -1)
    out[~alone] = trie.ends[node[~alone]]
    return out


def _children(trie: Trie, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the node, letter, child) of every edge of ``node``."""
    nodes = len(trie.first)
    alone = np.flatnonzero(node >= nodes)
    letter = trie.data[node[alone] - nodes]
    alone, letter = alone[letter > 0], letter[letter > 0]
    several = np.flatnonzero(node < nodes)
    begin = trie.first[node[several], 0]
    count = np.bitwise_count(trie.masks[node[several]]).sum(axis=1).astype(np.int64)
    edge = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    return np.concatenate((alone, np.repeat(several, count))), np.concatenate((letter, trie.labels[edge])), np.concatenate((node[alone] + 1, trie.children[edge]))


def neighbours(trie: Trie, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word of the trie) of every pair that is exactly one inserted, deleted or replaced letter apart, each once.

    A query's automaton reads the trie with no error on one path; at each node of it, every branch with
    an error is followed to its end before the path goes on. A repeated letter is
    inserted or deleted at the end of its run only, so no pair comes twice.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    query, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    depth = 0
    while len(query):
        at = starts[query] + depth
        letter = data[at]
        of, label, child = _children(trie, node)
        other = label != letter[of]
        replaced = other & (letter[of] > 0)
        deleted = np.flatnonzero((letter > 0) & (data[np.minimum(at + 1, len(data) - 1)] != letter))
        q = np.concatenate((query[of[replaced]], query[of[other]], query[deleted]))
        i = np.concatenate((at[of[replaced]] + 1, at[of[other]], at[deleted] + 1))
        v = np.concatenate((child[replaced], child[other], node[deleted]))
        while len(q):
            letter_ = data[i]
            over = letter_ == 0
            if over.any():
                word = _word_at(trie, v[over])
                found.append((q[over][word >= 0], word[word >= 0]))
                q, i, v, letter_ = q[~over], i[~over], v[~over], letter_[~over]
            v = _follow(trie, v, letter_)
            q, i, v = q[v >= 0], i[v >= 0] + 1, v[v >= 0]
        same = np.flatnonzero(~other)
        query, node = query[of[same]], child[same]
        depth += 1
    if not found:
        return (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_PARTS = Trie._fields
_KINDS = {"data": "u1", "labels": "u1", "masks": "u8"}


def _shards(words: DataFrame, sizes: Sizes) -> DataFrame:
    """A row for each shard of ``words`` (word, n): its size in bytes and the arrays of its trie. A shard is a range of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = []

        def flush() -> pa.RecordBatch:
            trie = build_trie([w for x, _ in held for w in x], [c for _, y in held for c in y])
            held.clear()
            raw = [np.ascontiguousarray(x).tobytes() for x in trie]
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, raw))], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], ["bytes", *_PARTS])

        size = 0
        for batch in batches:
            word, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = 0
            for k, w in enumerate(word):
                size += len(w) + 48
                if size >= sizes.shard_bytes:
                    held.append((word[begin : k + 1], n[begin : k + 1]))
                    begin, size = k + 1, 0
                    yield flush()
            held.append((word[begin:], n[begin:]))
        if size:
            yield flush()

    columns = ", ".join(f"{p} binary" for p in _PARTS)
    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, f"bytes long, {columns}")


def _loaded(row) -> Trie:
    arrays = [np.frombuffer(row[p], dtype=_KINDS.get(p, "i8")) for p in _PARTS]
    return Trie(*(x.reshape(-1, 2) if p in ("masks", "first") else x for p, x in zip(_PARTS, arrays, strict=True)))


def _search(words: DataFrame, tries, together: int) -> DataFrame:
    """word, n_near, best_n, best of the near words that each word has in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, together):
                part = batch.column(0).slice(k, together)
                data, starts = encoded(part.to_pylist())
                for trie in tries.value:
                    query, word = neighbours(trie, data, starts)
                    if not len(query):
                        continue
                    order = np.lexsort((word, -trie.n[word], query))
                    query, word = query[order], word[order]
                    first = np.flatnonzero(np.diff(query, prepend=-1))
                    count = np.diff(np.append(first, len(query)))
                    best = word[first]
                    ends = np.append(trie.starts[1:], len(trie.data)) - 1
                    text = [_LETTERS[trie.data[a:b]].tobytes().decode("latin-1") for a, b in zip(trie.starts[best].tolist(), ends[best].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(query[first])), pa.array(count, pa.int64()), pa.array(trie.n[best]), pa.array(text, pa.string())], ["word", "n_near", "best_n", "best"])

    return words.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """word, n_near, best_n, best of every word of ``words`` (word, n; distinct) that has a near one.

    Shards of the vocabulary are broadcast, ``pass_bytes`` of them at a time (one at least), and every word's
    automaton meets every shard. A pass is a written table, and its shards are let go before the next.
    """
    spark = words.sparkSession
    shards = stored(_shards(words, sizes).withColumn("shard", F.monotonically_increasing_id()), "trie-shards")
    passes, size = [[]], 0
    for row in shards.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if passes[-1] and size + row.bytes > sizes.pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append(row.shard)
        size += row.bytes
    tasks = -(-words.count() // sizes.task_words)
    dealt = words.select("word").repartition(max(tasks, 1), "word")
    found = []
    for chosen in passes:
        tries = spark.sparkContext.broadcast([_loaded(r) for r in shards.where(F.col("shard").isin(chosen)).toLocalIterator()])
        found.append(stored(_search(dealt, tries, sizes.together), "near-words"))
        tries.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    out = stored(every.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("least")).select("word", "n_near", (-F.col("least.m")).alias("best_n"), "least.best"), "near-words")
    for table in [shards, *found]:
        discard(table)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form), by doubling: counts grow with each form, so there are no rings."""
    up = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        jump = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(up.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        discard(up)
        up = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return up


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``word_counts(docs)``.

    n_near counts the words that are one inserted, deleted or replaced code point away. The
    form is the most frequent of them (ties: the first in code-point order) if it is ``RATIO`` times
    as frequent as the word, else null; the root is the end of the chain of forms, the word itself if it has none.
    Rows that repeat count each; other columns are ignored; an empty table gives an empty one.
    """
    words = stored(word_counts(docs, id_col, text_col), "variant-words")
    near = near_words(words, sizes)
    joined = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= F.col("n") * RATIO, F.lit(False)))
    formed = stored(joined.select("word", F.when(F.col("is_form"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n")), "variant-forms")
    roots = _roots(formed.where("form is not null"))
    out = formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = stored(out, "variants")
    for table in (words, near, formed, roots):
        discard(table)
    return out


def op13_query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, times, flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
  FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times FROM hashed
), v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), gone AS (
  SELECT DISTINCT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN v w ON w.word = g.rest
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN v w ON w.word = g.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
