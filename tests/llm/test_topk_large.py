"""Top-k where scores pass the range in which doubles are exact."""

import random

import numpy as np
import pytest

from leafline.llm import topk


@pytest.mark.parametrize("size", [3, 1 << 24, 1 << 31, 1 << 40])
def test_scores_of_any_size_are_exact(spark, size):
    r = random.Random(size)
    rows = [(i, [float(r.randint(-size, size)) for _ in range(r.randint(1, 6))]) for i in range(90)] + [(200, [float(size)] * 6), (201, [float(size)] * 6), (202, None), (None, [1.0]), (203, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = {i: [int(x) for x in v] for i, v in rows if i is not None and v is not None}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    got = {}
    for x in topk.exact_topk(df.where("id % 10 = 0"), df, "id", "v", k=5, candidate_block=40).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.item_id, x.score))
    for q in (i for i in whole if i % 10 == 0):
        best = sorted(((-dot(whole[q], v), i) for i, v in whole.items() if i != q))[:5]
        if all(abs(s) < 1 << 63 for s, _ in best):
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        else:
            assert all(-(1 << 63) <= s < 1 << 63 for *_, s in got[q]) and len(got[q]) == 5


def test_whole_numbers_and_doubles_walk_alike():
    r = np.random.default_rng(1)
    items = r.integers(-50, 50, (300, 8)).astype(float)
    whole = np.array([[int(x) for x in row] for row in items], dtype=object)
    ids, lists = np.arange(300), np.argsort(items, axis=0, kind="stable")
    for q in range(30):
        a, s = topk.threshold_topk(ids, items, items[q], q, 5, lists)
        b, t = topk.threshold_topk(ids, whole, whole[q], q, 5, lists)
        assert a.tolist() == list(b) and s.tolist() == list(t)
