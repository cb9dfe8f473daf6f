"""Label propagation against a plain version, shard by shard."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafline.llm import sharding


def plain(members, n_shards, capacity, rounds, first, bins, tie):
    """The same rule over dictionaries: members (node, grp, part, w)."""
    groups, weight, of = defaultdict(list), {}, defaultdict(list)
    for node, g, p, w in members:
        groups[g, p].append((node, w))
        of[node].append((g, p))
        weight[node] = max(w, weight.get(node, 0))
    label, bin_ = dict(first), {n: min(bins[g] for g in gs) for n, gs in of.items()}
    refused, most, idle = {}, -1, 0
    while True:
        seen = {g: defaultdict(int) for g in groups}
        for g, rows in groups.items():
            for node, w in rows:
                seen[g][label[node]] += w
        together = sum(n * n for s in seen.values() for n in s.values())
        idle, most = (0, together) if together > most else (idle + 1, most)
        if idle >= max(1, rounds):
            return label
        granted = []
        while not granted:
            wish = {}
            for node, gs in of.items():
                score = {s: (sum(seen[g][s] for g in gs), max(tie[g][s] for g in gs if s in seen[g]), s) for s in {s for g in gs for s in seen[g]}}
                open_ = [x for s, x in score.items() if (bin_[node], label[node], s) not in refused]
                if open_ and max(open_) > score[label[node]]:
                    wish[node] = max(open_)[2]
            wanted = defaultdict(int)
            for node, s in wish.items():
                wanted[bin_[node], label[node], s] += weight[node]
            if not wanted:
                return label
            load = defaultdict(int)
            for node, s in label.items():
                load[s] += weight[node]
            wanted = [(*k, w) for k, w in wanted.items()]
            granted = sharding.grant(wanted, load, capacity)
            done = set(granted)
            refused |= {(k, a, b): w for k, a, b, w in wanted if (a, b, k) not in done}
        for k, a, b, w in wanted:
            if (a, b, k) in done:
                load[a] -= w
                load[b] += w
        moved = {k for _, _, k in granted}
        refused = {t: w for t, w in refused.items() if t[0] not in moved and load[t[2]] + w > capacity}
        for node, s in wish.items():
            if (label[node], s, bin_[node]) in done:
                label[node] = s


@pytest.mark.parametrize(("seed", "overlap"), [(1, 0.0), (2, 0.3)])
def test_propagation_shard_by_shard(spark, seed, overlap):
    r = random.Random(seed)
    n_shards, rows, node = 4, [], 0
    for g in range(25):
        for _ in range(r.choice([2, 3, 5, 12, 30])):
            node += 1
            rows.append((node, g, 0, r.randint(1, 2)))
            if r.random() < overlap:
                rows.append((r.randint(1, node), g, 0, 1))
    rows = list({(n, g, p): (n, g, p, w) for n, g, p, w in rows}.values())
    members = spark.createDataFrame(rows, "node long, grp long, part int, w long")
    weight = defaultdict(int)
    for n, _, _, w in rows:
        weight[n] = max(weight[n], w)
    capacity = -(-sum(weight.values()) // n_shards) + 3
    first = {x.node: x.s for x in members.select("node", F.pmod(F.xxhash64(F.lit(sharding.SEED), "node"), F.lit(n_shards)).cast("int").alias("s")).distinct().collect()}
    hashes = members.select("grp", "part").distinct().select("grp", "part", F.pmod(F.xxhash64("grp", "part"), F.lit(sharding.MOVE_BINS)).cast("int").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("label")).select("grp", "part", "bin", "label", F.xxhash64("grp", "part", "label").alias("tie")).collect()
    bins, tie = {}, defaultdict(dict)
    for x in hashes:
        bins[x.grp, x.part] = x.bin
        tie[x.grp, x.part][x.label] = x.tie
    got = {x.node: x.label for x in sharding.propagate(members, n_shards, capacity).collect()}
    assert got == plain(rows, n_shards, capacity, sharding.ROUNDS, first, bins, tie)
    load = defaultdict(int)
    for n, s in got.items():
        load[s] += weight[n]
    if not overlap:
        together = sum(len({got[n] for n, h, _, _ in rows if h == g}) == 1 for g in range(25))
        assert together >= 20
