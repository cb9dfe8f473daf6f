"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

#: Each round halves the open nodes, so no graph that fits a cluster comes near this many.
MOST_ROUNDS = 500


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a long, b long).

    In each round every open node hooks to its neighbour with most links (ties by a hash of the round), if that one
    ranks before itself; hooks are followed to their roots by pointer jumping, and the links are
    contracted to links between roots. A node that stays has as many links as each of its neighbours at least, so no
    more nodes stay than hook: every round at least halves the open nodes, whatever the graph, a star goes in one, and the hash
    keeps the hooks of a path short. It ends when no link is left, and raises an error rather than return unsettled labels.

    Links are joined with their ends by node, where Spark splits the rows of a node with very many links (adaptive skew joins);
    what is counted of a node is summed before the shuffle. Each round is a written table. Links with a null end, links of a node with itself and repeated links change nothing;
    an empty table gives an empty table. Other columns are ignored.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    hooked: list[DataFrame] = []
    while edges.limit(1).count():
        if len(hooked) == MOST_ROUNDS:
            raise RuntimeError(f"components unsettled after {MOST_ROUNDS} rounds")
        rank = lambda c, links: F.struct((-F.col(links)).alias("links"), F.xxhash64(F.lit(len(hooked)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n_b"))
        first = both.join(degree, "b").groupBy(F.col("a").alias("node")).agg(F.min(rank("b", "n_b")).alias("best"), F.count("*").alias("n"))
        roots = _roots(stored(first.select("node", F.least("best", rank("node", "n"))["to"].alias("up")), "cc-hooks"))
        up = lambda c: roots.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        left = edges.join(up("a"), "a").join(up("b"), "b").where("a_up <> b_up")
        left = stored(left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "cc-links")
        discard(edges)
        edges = left
        hooked.append(roots)
    if not hooked:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooked[-1]
    for earlier in reversed(hooked[:-1]):
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("root"))
        labels = earlier.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    labels = stored(labels, "cc-labels")
    for done in [edges, *hooked]:
        discard(done)
    return labels.join(labels.groupBy("up").agg(F.min("node").alias("component")), "up").select("node", "component")


def _roots(hooks: DataFrame) -> DataFrame:
    """node, up of ``hooks`` with up followed to its root, which points at itself."""
    while True:
        jump = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
        further = hooks.join(jump, "up").select("node", F.col("further").alias("up"), (F.col("up") != F.col("further")).alias("moved"))
        further = stored(further, "cc-hooks")
        discard(hooks)
        hooks = further.select("node", "up")
        if not further.where("moved").limit(1).count():
            return hooks


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of ``found`` and of further ``links``: only links between components are looked at."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.unionByName(joined.join(found, "node", "left_anti"))
