"""Collocations against a plain version."""

import random
import re
from collections import Counter

import pytest

from leafline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = {}
    for (lang, w), a in found.items():
        longer = [c for (g, v), c in found.items() if g == lang and len(v) > len(w) and any(v[s : s + len(w)] == w for s in range(len(v) - len(w) + 1))]
        if any(100 * c >= cover * a for c in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def texts(seed, n, pieces=(" ", "  ", "\t", ", ", ". ", " ", " ", "\n", "!", " ")):
    r = random.Random(seed)
    some = ["new", "York", "city", "the", "of", "a", "É", "ß", "日本", "x", "New", "ÉÉ"]
    return [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(some) + r.choice(pieces) for _ in range(r.randint(0, 60)))) for _ in range(n)]


def frame(spark, rows):
    # columns that clash with those of the result
    return spark.createDataFrame([(i, t, g, "x", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, k int")


def found(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize(("longest", "least", "cover", "top"), [(3, 10, 50, 2000), (2, 3, 50, 5), (4, 4, 30, 40)])
def test_random_texts(spark, longest, least, cover, top):
    rows = [*texts(longest, 120), ("en", None), ("en", ""), ("en", " .,"), (None, "new york new york"), *[("en", "new york city of the")] * 30]
    got = phrases.collocations(frame(spark, rows), longest, least, cover, top)
    assert got.columns == COLUMNS and found(got) == brute(rows, longest, least, cover, top)


def test_full_tables_and_small_groups_change_nothing(spark):
    rows = texts(9, 150)
    sizes = phrases.Sizes(bits=8, group_bytes=300, together=50, counted_bits=12, hot_share=3)
    assert found(phrases.collocations(frame(spark, rows), sizes=sizes)) == brute(rows)


def test_long_texts_and_an_empty_table(spark):
    word = "Q" * 1_500_000
    rows = [("en", f"{word} {word} tail " * 2), ("en", "ab cd " * 400_000), ("en", "ab,cd " * 30)]
    got = found(phrases.collocations(frame(spark, rows), min_count=2))
    assert got == brute(rows, least=2)
    assert found(phrases.collocations(frame(spark, rows).limit(0))) == set()


def test_products_beyond_64_bits(spark):
    # counts as they come from the level tables: the scores are exact whatever their size
    big = 3_037_000_507
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").selectExpr("(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s")
    assert df.first().s == 1_000_000 * big * big // ((big + 1) * (big + 2))
