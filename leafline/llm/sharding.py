"""Sharding by balanced label propagation."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, stored

ROUNDS = 4
MOVE_BINS = 1024
SEED = 5


def link_histograms(members: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, part, label, n: how many rows of each group are in each shard; summed before the shuffle."""
    return members.join(labels.select("node", "label"), "node").groupBy("grp", "part", "label").agg(F.sum("w").alias("n"))


def wanted_moves(members: DataFrame, labels: DataFrame, seen: DataFrame, refused: list[tuple[int, int, int]] = ()) -> DataFrame:
    """node, label, best, bin, w for nodes with more neighbours in another shard that has not refused them.

    A node's neighbours are the rows of its groups, counted in ``seen``; ``refused`` has (bin, from, to). Ties go to the shard that a hash of group and
    shard ranks first, the same for all of a group, so that halves don't swap for ever.
    """
    order = F.xxhash64("grp", "part", "label")
    score = members.join(seen, ["grp", "part"]).groupBy("node", "label").agg(F.sum("n").alias("n"), F.max(order).alias("tie"))
    score = score.join(labels.withColumnRenamed("label", "own"), "node")
    free = F.lit(True)
    if refused:
        closed = members.sparkSession.createDataFrame(list(refused), "bin int, own int, label int").withColumn("closed", F.lit(True))
        score, free = score.join(F.broadcast(closed), ["bin", "own", "label"], "left"), F.col("closed").isNull()
    option = F.struct("n", "tie", "label")
    best = score.groupBy("node", "own", "bin", "w").agg(F.max(F.when(free, option)).alias("top"), F.max(F.when(F.col("label") == F.col("own"), option)).alias("now"))
    return best.where(F.col("top") > F.col("now")).select("node", F.col("own").alias("label"), F.col("top.label").alias("best"), "bin", "w")


def grant(wanted: list[tuple[int, int, int, int]], load: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(from, to, bin) of the moves that the capacity quotas allow, one bin of groups after the other, those with most rows first.

    ``wanted`` has (bin, from, to, rows), of bounded length: bins times pairs of shards.
    """
    load, out, size = defaultdict(int, load), [], defaultdict(int)
    for bin_, _, _, w in wanted:
        size[bin_] += w
    left = sorted(wanted, key=lambda m: (-size[m[0]], m))
    while left:  # what moves away makes room for those refused before
        again = []
        for bin_, a, b, w in left:
            if load[b] + w <= capacity:
                load[b] += w
                load[a] -= w
                out.append((a, b, bin_))
            else:
                again.append((bin_, a, b, w))
        if len(again) == len(left):
            break
        left = again
    return out


def propagate(members: DataFrame, n_shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """node, label after balanced label propagation over ``members`` (node, grp, part, w).

    Every round each node asks for the shard that holds most of its neighbours; requests are counted by
    (from, to, bin of groups) and granted as far as no shard takes linked rows beyond ``capacity``.
    What is refused asks for the next best shard, until that shard has room or other rows of the bin have moved. It ends when nothing
    is asked for any more. Where each node is in one group, each round brings more rows of a group together, so it does end;
    nodes of several groups may swap for ever, so it also ends after ``rounds`` moves without more rows together than ever before.
    """
    spark = members.sparkSession
    bin_ = F.min(F.pmod(F.xxhash64("grp", "part"), F.lit(MOVE_BINS))).cast("int")
    nodes = members.groupBy("node").agg(F.max("w").alias("w"), bin_.alias("bin"))
    labels = stored(nodes.select("node", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(n_shards)).cast("int").alias("label"), "w", "bin"), "shard-labels")
    refused: dict[tuple[int, int, int], int] = {}
    most, idle = -1, 0
    while True:
        seen = stored(link_histograms(members, labels), "shard-seen")
        together = int(seen.agg(F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")).alias("t")).first().t or 0)
        idle, most = (0, together) if together > most else (idle + 1, most)
        if idle >= max(1, rounds):
            break
        granted = []
        while not granted:
            moves = stored(wanted_moves(members, labels, seen, list(refused)), "shard-moves")
            wanted = [tuple(r) for r in moves.groupBy("bin", "label", "best").agg(F.sum("w").alias("w")).collect()]
            if not wanted:
                return labels.select("node", "label")
            load = defaultdict(int, {r.label: r.w for r in labels.groupBy("label").agg(F.sum("w").alias("w")).collect()})
            granted = grant(wanted, load, capacity)
            done = set(granted)
            refused |= {(k, a, b): w for k, a, b, w in wanted if (a, b, k) not in done}
        for k, a, b, w in wanted:
            if (a, b, k) in done:
                load[a] -= w
                load[b] += w
        moved = {k for _, _, k in granted}
        refused = {t: w for t, w in refused.items() if t[0] not in moved and load[t[2]] + w > capacity}
        allowed = F.broadcast(spark.createDataFrame(granted, "label int, best int, bin int"))
        went = moves.join(allowed, ["label", "best", "bin"]).select("node", "best")
        new = stored(labels.join(went, "node", "left").select("node", F.coalesce("best", "label").alias("label"), "w", "bin"), "shard-labels")
        for gone in (labels, moves, seen):
            discard(gone)
        labels = new
    return labels.select("node", "label")


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size long, text_crc32 long, shard int, slot long, then ``carry``, for each row of ``docs``.

    Rows with equal texts are linked. Linked documents start in a shard by a hash and move towards
    their neighbours' shards by balanced label propagation; a group of more rows than a
    shard is first dealt into parts by a hash, as no shard could hold it. Unlinked rows then fill
    every shard to the same number of rows (at most one apart), with gapless slots from 0. All ranks are
    counted within bins of a hash and offset by the bins before, so no
    task ranks a whole shard.

    Null text is linked with nothing, has size 1 and crc 0; the empty text is a text. A null id is
    linked with nothing. Rows that repeat an id and a text are separate rows of one document. An empty
    table gives an empty table. Other columns are ignored unless carried.
    """
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull() & F.col(id_col).isNotNull(), F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))).alias("grp"),
            F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total = rows.count()
    capacity = total // n_shards
    linked = rows.where("grp is not null").groupBy("grp").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("c") / max(1, capacity))).cast("long")
    members = rows.where("grp is not null").join(linked, "grp").select(F.col("id").alias("node"), "grp", F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), parts).cast("int").alias("part"))
    members = stored(members.groupBy("node", "grp", "part").agg(F.count("*").alias("w")), "shard-members")
    labels = propagate(members, n_shards, capacity, rounds)

    bins = max(64, min(1 << 16, total // (n_shards * 10_000)))
    # rows without a shard are as many as those of all shards, and rows without an id are told apart by their number alone
    label, spread = F.coalesce("label", F.lit(-1)), F.when(F.col("id").isNull(), F.xxhash64(F.lit(SEED + 2), "row")).otherwise(F.xxhash64(F.lit(SEED + 2), "id", "grp"))
    placed = rows.join(labels, F.col("id") == F.col("node"), "left").select("id", "size", "text_crc32", "carried", label.alias("label"), F.pmod(spread, F.when(label < 0, bins * n_shards).otherwise(bins)).alias("bin"), "grp", "row")
    placed = stored(placed, "shard-placed")
    counts = stored(placed.groupBy("label", "bin").agg(F.count("*").alias("c")), "shard-bins")
    before = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("label", "bin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("label", "bin").orderBy("id", "grp", "row")
    ranked = placed.join(offsets, ["label", "bin"]).withColumn("pos", F.col("before") + F.row_number().over(within) - 1)

    load = {r.label: r.c for r in counts.groupBy("label").agg(F.sum("c").alias("c")).collect()}
    room = {s: capacity + (s < total % n_shards) for s in range(n_shards)}
    held = {s: min(load.get(s, 0), room[s]) for s in room}
    # rows without a shard come first among the fillers, then what a shard holds beyond its room
    start, spare = load.get(-1, 0), {}
    for s in room:
        spare[s] = start - room[s]
        start += load.get(s, 0) - held[s]
    filler, shard, slot, upto = F.when(F.col("label") == -1, F.col("pos")), F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in room:
        filler = filler.when((F.col("label") == s) & (F.col("pos") >= room[s]), F.col("pos") + spare[s])
    ranked = ranked.withColumn("filler", filler)
    shard, slot = F.when(F.col("filler").isNull(), F.col("label")), F.when(F.col("filler").isNull(), F.col("pos"))
    for s in room:
        end = upto + room[s] - held[s]
        mine = (F.col("filler") >= upto) & (F.col("filler") < end)
        shard, slot = shard.when(mine, F.lit(s)), slot.when(mine, F.col("filler") - upto + held[s])
        upto = end
    kept = [F.col(f"carried.{c}").alias(c) for c in carry]
    return ranked.select("id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), *kept)


def op5_query(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
