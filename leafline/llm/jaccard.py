"""Groups of documents by word n-gram Jaccard similarity: a size-aware heavy-light join.

Small ("light") sets enumerate the fixed-size subsets that a partner must share;
large ("heavy") sets scan inverted lists of their rarest shingles. The boundary
is the size at which the sum of both costs is least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .storage import discard, stored
from .textnp import NOT_SPACE, column_bytes, distinct_by_row, mix, row_groups, shingles, words

#: Cost of scanning an entry of an inverted list, in subsets enumerated.
SCAN_COST = 8
#: Largest size that the boundary may take.
LARGEST_LIGHT = 40
#: Members of an inverted list that are compared with each other in a round.
BLOCK = 32
ROUNDS = 5
#: Slots of the table of frequent shingles and bits of the table of wanted ids; both are broadcast, 4 and 2 MB.
TIER_BITS = 22
WANTED_BITS = 24
#: A shingle in so many sets of those that are counted together is reported as frequent.
FREQUENT = 2
#: Shingles of sets that are counted together, about.
COUNTED_TOGETHER = 3_000_000
#: Cells that a set's shingles are counted in.
CELLS = 128


def required(a: int, b: int, percent: int) -> int:
    """Shingles that sets of these sizes must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int):
    """Of the n shingles in any fixed order, this many contain one of any linked set's."""
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n shingles may have to share with a linked set."""
    return sorted({o for b in range(-(-percent * n // 100), 100 * n // percent + 1) if (o := required(n, b, percent)) <= min(n, b)})


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size: the least cost of enumeration up to it and of scanned lists from just below it on."""
    light = lambda n: sum(math.comb(n, o) for o in subset_sizes(n, percent))
    heavy = lambda n: SCAN_COST * prefix_length(n, percent)
    reach = range(1, 100 * (LARGEST_LIGHT + 1) // percent + 2)

    def cost(edge: int) -> int:
        low = -(-percent * (edge + 1) // 100)
        return sum(sizes.get(n, 0) * light(n) for n in range(1, edge + 1)) + sum(sizes.get(n, 0) * heavy(n) for n in reach if n >= low)

    return min(range(0, LARGEST_LIGHT + 1), key=lambda edge: (cost(edge), edge))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, values, row of each) of distinct shingles, a group of rows at a time."""
    data, offsets = column_bytes(batch, "text")
    for i, j in row_groups(offsets):
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        hashes, rows, _, _ = words(part, at, NOT_SPACE)
        values, of = distinct_by_row(*shingles(hashes, rows, j - i, width))
        yield i, j - i, values, of


def _by_row(values: np.ndarray, of: np.ndarray, n: int, join=np.add) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    if len(of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[first]] = join.reduceat(values, first)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Two sums over each row's set that tell sets apart."""
    return _signed(_by_row(mix(values), of, n)), _signed(_by_row(mix(values + np.uint64(77)), of, n))


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """id, hash, n, a, b of each row: the size of its set and two sums that identify it; and, with null n, possibly frequent shingles a in b sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, held = [], 0
            for i, n, values, of in _sets(batch, width):
                every.append(values)
                held += len(values)
                sizes = np.bincount(of, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(sizes, pa.int64()), *_sums(values, of, n)], names=["id", "hash", "n", "a", "b"])
                if held >= COUNTED_TOGETHER or i + n == batch.num_rows:
                    values, counts = np.unique(np.concatenate(every), return_counts=True)
                    every, held, often = [], 0, counts >= FREQUENT
                    if often.any():
                        none = pa.nulls(int(often.sum()), pa.int64())
                        yield pa.RecordBatch.from_arrays([none, none, none, _signed(values[often]), pa.array(counts[often], pa.int64())], names=["id", "hash", "n", "a", "b"])

    return docs.mapInArrow(run, "id long, hash long, n long, a long, b long")


def _tiers(frequent: DataFrame) -> np.ndarray:
    """For each slot of shingles, the log2 of how many sets the most frequent of them was reported in; 0 for most."""
    slots = frequent.groupBy("a").agg(F.sum("b").alias("df")).groupBy(F.shiftrightunsigned("a", 64 - TIER_BITS).cast("int").alias("slot")).agg(F.max(F.floor(F.log2("df"))).cast("int").alias("tier")).toArrow()
    out = np.zeros(1 << TIER_BITS, dtype=np.uint8)
    out[slots["slot"].to_numpy()] = slots["tier"].to_numpy()
    return out


def _candidates(docs: DataFrame, width: int, percent: int, edge: int, tiers: np.ndarray) -> DataFrame:
    """id, n, a, b, prefix array<long> (heavy, rarest first), subsets array<struct<o, s, t>> (light), cells array<int>, and u and v (16 coarse cells of a byte each) of each row with a set."""
    shared = docs.sparkSession.sparkContext.broadcast(tiers)
    low = -(-percent * (edge + 1) // 100)
    subset = pa.struct([("o", pa.int32()), ("s", pa.int64()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i, n, values, of in _sets(batch, width):
                cells = np.bincount(of * CELLS + (values & np.uint64(CELLS - 1)).astype(np.int64), minlength=n * CELLS)
                coarse = np.minimum(cells.reshape(n, CELLS // 16, 16).sum(1), 255).astype(np.uint8)
                sums = _sums(values, of, n)
                # rarest first: by tier, then by value
                tier = table[(values >> np.uint64(64 - TIER_BITS)).astype(np.int64)]
                values = values[np.argsort(of * 64 + tier, kind="stable")]
                sizes = np.bincount(of, minlength=n)
                begins = np.concatenate(([0], np.cumsum(sizes)))
                length = np.where(sizes >= max(1, low), prefix_length(sizes, percent), 0)
                within = np.arange(len(values)) - begins[of]
                chosen = values[within < length[of]]
                prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), _signed(chosen))
                light: list[list[dict]] = [[] for _ in range(n)]
                for r in np.flatnonzero((sizes > 0) & (sizes <= edge)).tolist():
                    mine = values[begins[r] : begins[r + 1]]
                    s, t = (x.tolist() for x in (mix(mine), mix(mine + np.uint64(77))))
                    for o in subset_sizes(len(mine), percent):
                        for gone in combinations(range(len(mine)), len(mine) - o):
                            key = [(sum(x) - sum(x[g] for g in gone)) & 0xFFFFFFFFFFFFFFFF for x in (s, t)]
                            light[r].append({"o": o, "s": key[0] - (1 << 64) * (key[0] >> 63), "t": key[1] - (1 << 64) * (key[1] >> 63)})
                counted = pa.ListArray.from_arrays(pa.array(np.arange(0, n * CELLS + 1, CELLS), pa.int32()), pa.array(cells, pa.int32()))
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(sizes, pa.int64()), *sums, prefixes, pa.array(light, pa.list_(subset)), counted, _signed(coarse[:, :8].copy().view(np.uint64).ravel()), _signed(coarse[:, 8:].copy().view(np.uint64).ravel())], names=["id", "n", "a", "b", "prefix", "subsets", "cells", "u", "v"])
                yield rows.filter(pa.array(sizes > 0))

    return docs.mapInArrow(run, "id long, n long, a long, b long, prefix array<long>, subsets array<struct<o:int,s:bigint,t:bigint>>, cells array<int>, u long, v long")


def _light_links(light: DataFrame, percent: int) -> DataFrame:
    """a, b: every light set and the smallest set that it shares a large enough subset with, one for each subset.

    Sets with a common subset of o shingles link if their sizes add up to o * (100 + percent) / percent
    at most, so a set that doesn't link with the smallest one links with none of them through this subset.
    """
    rows = light.select("sid", "n", F.explode("subsets").alias("k")).select("sid", "n", "k.o", "k.s", "k.t")
    least = rows.groupBy("o", "s", "t").agg(F.min(F.struct("n", "sid")).alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = rows.join(least, ["o", "s", "t"]).where((F.col("sid") != F.col("hub.sid")) & ((F.col("n") + F.col("hub.n")) * percent <= F.col("o") * (100 + percent)))
    return near.select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).distinct()


def _lists(entries: DataFrame) -> DataFrame:
    """token, sid, n, pos, u, v, c, hub: the inverted lists of prefix shingles, with their length and their smallest set.

    ``pos`` is how many rarer shingles of the set come before. Lists with the same members are one: the rarest
    of their shingles stands for all, as it comes before the others in every member.
    """
    # shuffled once, for the counts and for the lists: hardly any shingle comes twice in a task, so nothing is gained by counting before
    heavy = entries.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).where("token is not null").repartition("token")
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "sid")).alias(f"mark{seed}")
    counts = heavy.groupBy("token").agg(F.count("*").alias("c"), mark(0), mark(1), F.min(F.struct("sid", "n", "pos")).alias("hub")).where("c > 1")
    chosen = counts.groupBy("c", "mark0", "mark1").agg(F.min(F.struct("hub.pos", "token", "hub")).alias("k")).select("k.token", "c", "k.hub")
    coarse = entries.select("sid", "u", "v")
    hubs = chosen.join(coarse.withColumnRenamed("sid", "h"), F.col("hub.sid") == F.col("h")).select("token", "c", F.struct("hub.sid", "hub.n", "hub.pos", "u", "v").alias("hub"))
    return heavy.join(hubs, "token").join(coarse, "sid")


def _shingle_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """sid, items array<long> of the sets in ``wanted`` (sid, id, n, a, b).

    A bitmap of the wanted ids, built by bitmap aggregates and broadcast, keeps most other texts from being read into words.
    """
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - WANTED_BITS)
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    marked = docs.select("id", "text", F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p")).join(F.broadcast(bits), "k")
    rows = marked.where("shiftright(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) & 1 = 1").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, values, of in _sets(batch, width):
                sizes = np.bincount(of, minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), _signed(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(sizes, pa.int64()), *_sums(values, of, n), lists], names=["id", "n", "a", "b", "items"]).filter(pa.array(sizes > 0))

    made = rows.mapInArrow(run, "id long, n long, a long, b long, items array<long>")
    return made.join(wanted, ["id", "n", "a", "b"]).dropDuplicates(["id", "n", "a", "b"]).select("sid", "items")


def _close(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose counts of shingles by cell differ by no more in sum than linked sets' can; few unlinked pairs pass."""
    x = cells.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    y = cells.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    return pairs.join(x, "a").join(y, "b").where(_near("na", "ca", "nb", "cb", percent)).select("a", "b")


def _verified(close: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``close`` (a, b) that link, by the exact sizes of their intersections and unions."""
    both = close.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("xs")), "a").join(sets.select(F.col("sid").alias("b"), F.col("items").alias("ys")), "b")
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.where(shared * (100 + percent) >= (F.size("xs") + F.size("ys")) * percent).select("a", "b")


def _near(n: str, cells: str, m: str, others: str, percent: int):
    """Whether counts by cell differ by no more in sum than linked sets of these sizes can."""
    apart = F.aggregate(F.zip_with(cells, others, lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    total = F.col(n) + F.col(m)
    return apart <= total - 2 * F.ceil(total * percent / (100 + percent))


def _fits(x: str, y: str, percent: int):
    """Whether sets of these sizes can link if this is the rarest shingle that they share, and their coarse cells allow it."""
    c = lambda side, name: F.col(f"{side}.{name}")
    byte = lambda side, name, k: F.shiftright(c(side, name), 8 * k).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(x, w, k) - byte(y, w, k)) for w in "uv" for k in range(8)), F.lit(0))
    total = c(x, "n") + c(y, "n")
    needed = F.ceil(total * percent / (100 + percent))
    return (c(x, "pos") + needed <= c(x, "n")) & (c(y, "pos") + needed <= c(y, "n")) & (apart <= total - 2 * needed)


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (id, hash, n, a, b) of the rows of ``docs`` (id, hash, text), the distinct sets (sid, id, hash, n, a, b; the first row that has it), and the components (node, component) of linked sets.

    Light sets link through shared subsets, exactly and without comparing pairs. Heavy sets enter the inverted
    lists of their rarest shingles; each list is first compared with its smallest set only, then, in rounds, in
    blocks of ``BLOCK`` members, only where they are not yet connected; once a
    round finds nothing (or after ``ROUNDS``), the pairs that are still unconnected in long lists are compared last, all of them.
    Pairs whose sizes and places in the list rule a link out are not made.
    """
    profiles = stored(_profiles(docs, width), "jaccard-profiles")
    rows = profiles.where("n is not null")
    reps = rows.where("n > 0 and id is not null").groupBy("n", "a", "b").agg(F.min(F.struct("id", "hash")).alias("k"))
    # numbered once, in a written table, so that a number stays with its set
    reps = stored(reps.select(F.monotonically_increasing_id().alias("sid"), "k.id", "k.hash", "n", "a", "b"), "jaccard-reps")
    sizes = {r.n: r["count"] for r in reps.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").count().collect()}
    edge = boundary(sizes, percent)
    tiers = _tiers(profiles.where("n is null"))

    made = _candidates(docs, width, percent, edge, tiers).join(reps.drop("hash"), ["id", "n", "a", "b"]).dropDuplicates(["id", "n", "a", "b"])
    entries = stored(made.drop("id", "a", "b"), "jaccard-entries")
    light = stored(_light_links(entries.where(F.size("subsets") > 0), percent), "jaccard-links")
    lists = stored(_lists(entries), "jaccard-lists")
    cells = stored(entries.select("sid", "n", "cells").join(lists.select("sid").distinct(), "sid", "left_semi"), "jaccard-cells")
    discard(entries)

    def sets_of(sids: DataFrame) -> DataFrame:
        wanted = stored(reps.drop("hash").join(sids.distinct(), "sid", "left_semi"), "jaccard-wanted")
        out = stored(_shingle_sets(docs, width, wanted), "jaccard-sets")
        discard(wanted)
        return out

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    stars = lists.where("sid <> hub.sid").select("hub", F.struct("sid", "n", "pos", "u", "v").alias("own")).where(_fits("hub", "own", percent))
    close = stored(_close(stars.select(F.col("hub.sid").alias("a"), F.col("own.sid").alias("b")).distinct(), cells, percent), "jaccard-close")
    sets = sets_of(ends(close))
    found = stored(components(light.unionByName(_verified(close, sets, percent))), "jaccard-found")
    for done in (light, close, sets):
        discard(done)
    k, last = 1, False
    while True:
        left = lists if k == 1 else lists.where(F.col("c") > BLOCK)
        left = left.join(found, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "pos", "u", "v", "c", F.coalesce("component", "sid").alias("comp"))
        # lists that still hold more than one component, and the one that most of their members are in
        main = F.mode("comp") if last else F.min("comp")
        open_ = left.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), main.alias("main")).where("lo < hi").select("token", "main")
        left = left.join(open_, "token")
        left = stored(left.join(cells.select("sid", "cells"), "sid") if k > 1 else left, "jaccard-open")
        differ = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _fits("x", "y", percent)
        differ = differ & _near("x.n", "x.cells", "y.n", "y.cells", percent) if k > 1 else differ
        if last:
            once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
            near = left.where("comp <> main").alias("x").join(left.alias("y"), differ & once)
        else:
            blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("c") / BLOCK)))).cast("long")
            cell = left.withColumn("block", F.pmod(F.xxhash64(F.lit(k), F.col("sid")), blocks))
            near = cell.alias("x").join(cell.alias("y"), differ & (F.col("x.block") == F.col("y.block")) & (F.col("x.sid") < F.col("y.sid")))
        pairs = near.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
        close = stored(_close(pairs, cells, percent) if k == 1 else pairs, "jaccard-close")
        if k <= 2:  # the sets of the second round's lists are all that later rounds ask for
            sets = sets_of(ends(close) if k == 1 else left.select("sid"))
        new = stored(_verified(close, sets, percent), "jaccard-new")
        fresh = new.limit(1).count() > 0
        if fresh:
            found = stored(merged(found, new), "jaccard-found")
        more = left.where(F.col("c") > BLOCK).limit(1).count() > 0
        for done in (left, close, new, *([sets] if k == 1 else [])):
            discard(done)
        if last or not more:
            break
        k += 1
        last = k > ROUNDS or (k > 2 and not fresh)
    for done in (lists, cells):
        discard(done)
    return rows, reps, found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))


def _firsts(reps: DataFrame, found: DataFrame) -> DataFrame:
    """n, a, b, first struct<id, hash>: each distinct set and the first row of its component."""
    label = reps.join(found, F.col("sid") == F.col("node"), "left").select("n", "a", "b", F.struct("id", "hash").alias("own"), "component")
    first = label.where("component is not null").groupBy("component").agg(F.min("own").alias("first"))
    return label.join(first, "component", "left").select("n", "a", "b", F.coalesce("first", "own").alias("first"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """id long, n_shingles long, component_id long for each row.

    A row's set holds its distinct ``width``-word shingles (words are runs of other than
    ASCII white space, A-Z lower-cased); a shorter text's set is its whole sequence of words.
    Rows link if 100 * intersection >= percent * union; component_id is the smallest id
    reachable by links. Rows with equal sets are one from the start; no link between components is lost, and a group of like texts
    costs about one comparison a member.

    Null and empty texts and texts of white space have no set and link with nothing;
    a null id is left out of all links and gets a null component; rows that share an id are
    one document with the links of all their texts. An empty table gives an empty table. Other columns are ignored.
    """
    rows, reps, found = _linked(_keyed(docs, id_col, text_col), width, percent)
    # an id with several sets joins their components
    several = rows.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("n", "a", "b")).alias("lo"), F.max(F.struct("n", "a", "b")).alias("hi")).where("lo <> hi").select("id", "lo")
    several = stored(several, "jaccard-several")
    if several.limit(1).count():
        number = lambda c: reps.select("n", "a", "b", F.col("sid").alias(c))
        pairs = rows.join(several, "id").join(number("a_sid"), ["n", "a", "b"]).select("lo.*", "a_sid").join(number("b_sid"), ["n", "a", "b"])
        found = merged(found, pairs.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct())
    firsts = _firsts(reps, found).select("n", "a", "b", F.col("first.id").alias("first"))
    out = rows.where("n > 0").join(firsts, ["n", "a", "b"], "left").select("id", F.col("n").alias("n_shingles"), F.expr("if(id is null, null, first)").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    Rows with a null id or without words stay. Of rows that repeat a doc_id and a text one stays; rows of one
    doc_id with texts that don't link stay.
    """
    rows, reps, found = _linked(_keyed(docs, "doc_id", "text"), width, percent)
    marked = rows.where("n > 0 and id is not null").join(_firsts(reps, found), ["n", "a", "b"])
    gone = marked.where("struct(id, hash) <> first").select("id", "hash").distinct()
    same = (F.col("d.doc_id") == F.col("g.id")) & (F.xxhash64("d.text") == F.col("g.hash"))
    kept = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, width=3, percent=90).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0))
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), c AS (
  SELECT doc_id AS a, doc_id AS r FROM z
  UNION
  SELECT c.a, l.b FROM c JOIN l ON c.r = l.a
), m AS (
  SELECT a, min(r) AS component_id FROM c GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
