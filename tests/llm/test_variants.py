"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from leafline.llm import variants

LETTERS = "abcÀéÿ"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(found[w]), n.get(form[w])) for w in n}


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def words(seed, n, low=0, high=7):
    r = random.Random(seed)
    return sorted({"".join(r.choices(LETTERS, k=r.randint(low, high))) for _ in range(n)})


def test_automata_find_every_near_word_once():
    for seed, (low, high) in enumerate([(0, 4), (1, 7), (5, 6), (2, 2), (9, 12)]):
        vocabulary, queries = words(seed, 400, low, high), sorted({*words(seed + 50, 300, low, high), "", "a" * 3000})
        trie = variants.build_trie(vocabulary, list(range(len(vocabulary))))
        q, w = variants.neighbours(trie, *variants.encoded(queries))
        got = [(queries[a], vocabulary[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)]
        assert len(set(got)) == len(got) and set(got) == {(a, b) for a in set(queries) for b in vocabulary if near(a, b)}


def test_tries_of_one_and_of_very_long_words():
    long = "ab" * 20_000
    vocabulary = sorted([long, long + "c", long[:-1] + "é", "abcdef"])
    trie = variants.build_trie(vocabulary, [1] * 4)
    q, w = variants.neighbours(trie, *variants.encoded([long, "abcdeg"]))
    assert {(a, vocabulary[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)} == {(0, long + "c"), (0, long[:-1] + "é"), (1, "abcdef")}
    one = variants.build_trie(["abcdef"], [5])
    q, w = variants.neighbours(one, *variants.encoded(["abcdef", "abcde", "bbcdef"]))
    assert sorted(q.tolist()) == [1, 2] and w.tolist() == [0, 0]
    assert np.array_equal(one.ends, [-1])


def corpus(seed, n):
    r = random.Random(seed)
    some = ["".join(r.choices(LETTERS, k=r.randint(5, 8))) for _ in range(60)]
    some += [w[:k] + r.choice(LETTERS) + w[k + 1 :] for w in some[:30] for k in (0, 3)] + [w + w[-1] for w in some[:20]]
    weight = [r.choice((1, 5, 30)) for _ in some]
    return [(r.randint(0, 10**6), r.choice((" ", "1", ", ")).join(x.upper() if r.random() < 0.1 else x for x in r.choices(some, weight, k=r.randint(0, 60)))) for _ in range(n)]


def test_whole_results(spark):
    rows = [*corpus(3, 300), (1, None), (2, ""), (None, "abcdef " * 6), (4, "x" * 2_000_000), (5, "ABCDEF abcdeg " * 40), (5, "ABCDEF abcdeg " * 40)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    expected = sorted(brute(rows), key=str)
    assert len({r for _, f, r, *_ in expected if f}) > 3 and any(f and f != r for _, f, r, *_ in expected)
    assert result(variants.spelling_variants(docs)) == expected
    small = variants.Sizes(shard_bytes=600, pass_bytes=9000, together=7, task_words=50)
    assert result(variants.spelling_variants(docs, sizes=small)) == expected
    assert result(variants.spelling_variants(docs.limit(0))) == []
