"""Methods against plain versions: components, repeated ids, long texts and words, sentence losses, letter trigrams, the queries' columns."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_llm import DOCS, WORDS, brute_components, texts

from leafline.llm import components, decontaminate, jaccard, langid, secrets, sharding, textnp, toxicity, warc


def test_components_of_a_long_random_path(spark):
    ids = list(range(700))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (5000, 6000), (6000, 7000), (3, 3), (None, 9)], "a long, b long")
    found = components.components(links).cache()
    assert {r.node: r.component for r in found.collect()} == {i: 0 for i in ids} | {5000: 5000, 6000: 5000, 7000: 5000}
    more = spark.createDataFrame([(7000, 699), (8000, 8001)], "a long, b long")
    assert {r.node: r.component for r in components.merged(found, more).collect()} == {i: 0 for i in [*ids, 5000, 6000, 7000]} | {8000: 8000, 8001: 8000}
    assert components.components(links.limit(0)).count() == 0


def test_a_chain_of_near_copies_is_one_component(spark):
    # each text links with its neighbours only, so the component is a path
    words = [f"w{i}" for i in range(100)]
    chain = []
    for k in range(60):
        chain.append((k * 7 % 60, " ".join(words)))
        words = words[2:] + [f"x{k}a", f"x{k}b"]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == brute_components(chain, 3, 90) and {c for _, c in got.values()} == {0}


def test_rows_that_share_an_id_have_the_links_of_all_their_texts(spark):
    a, b, c = texts(3, 5, 30, 30)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c)]
    got = {(r.id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
    docs = spark.createDataFrame([(1, a, "", "", 1), (1, b, "", "", 1), (2, a + " end", "", "", 1), (4, c, "", "", 1), (4, c, "", "", 1), (None, a, "", "", 1)], DOCS)
    assert sorted((str(r.doc_id), r.text) for r in jaccard.keep_first(docs).collect()) == sorted([("1", a), ("1", b), ("4", c), ("None", a)])


def test_long_texts_and_words(spark):
    r = random.Random(8)
    long = " ".join(r.choices(WORDS, k=500_000))
    word = "q" * 2_500_000
    secret = "password = " + "k3y" * 20
    rows = [(1, long), (2, long + " end"), (3, word), (4, f"{word} {word} tail {secret}"), (5, None), (6, "")]
    assert len(long) > 2 * textnp.PIECE and len(word) > 2 * textnp.PIECE
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {x.id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df).collect()}
    w = long.split()
    n = len(set(zip(w, w[1:], w[2:], strict=False)))
    assert groups == {1: (n, 1), 2: (n + 1, 1), 3: (1, 3), 4: (len(set(zip(*[f"{word} {word} tail {secret}".split()[k:] for k in range(3)], strict=False))), 4), 5: (0, 5), 6: (0, 6)}
    items = spark.createDataFrame([(1, " ".join(w[-12:])), (2, word)], "item_id long, text string")
    hits = {x.doc_id: (x.n_words, sum(h.end - h.start for h in x.hits), x["items"]) for x in decontaminate.find_overlaps(df, items).select("doc_id", "n_words", "hits", "items").collect()}
    assert hits[1][0] == 500_000 and hits[1][1] >= 12 and hits[1][2] == hits[2][2] == [1] and hits[2][0] == 500_001
    assert hits[3] == (1, 1, [2]) and hits[4][1:] == (2, [2]) and hits[5] == hits[6] == (0, 0, [])
    found = {x.id: [(s.start, s.end) for s in x.spans if s.kind == "assign"] for x in secrets.scan(df.where("doc_id >= 3")).collect()}
    at = 2 * len(word) + len("  tail ")
    assert found == {3: [], 4: [(at, at + len(secret))], 5: [], 6: []}
    model = langid.learn(spark.createDataFrame([(" ".join(WORDS), "en")], "text string, lang string"))
    langs = {x.doc_id: x.lid_lang for x in langid.identify(df, model).collect()}
    assert langs == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und", 6: "und"}
    weights = np.append(np.zeros(1 << toxicity.BITS), (toxicity.START, 0.0))
    scores = {x.id: x.score for x in toxicity.score(df, weights).collect()}
    assert all(0 < scores[i] < 0.1 for i in (1, 2, 3, 4)) and scores[5] == scores[6] == 0


def test_nothing_learned_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 !", None, "s", 1), (3, None, None, "s", 1), (4, "слово", None, None, None)], DOCS)
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [1, 4]


def test_sentence_slopes_are_those_of_the_loss():
    r = np.random.default_rng(2)
    bag, label, z = np.array([0, 0, 1, 1, 1, 2, 3]), np.array([1, 0, 1, 0]), r.normal(-1, 1, 7)

    def loss(z):
        total = 0.0
        for d, y in enumerate(label):
            none = math.prod(1 - 1 / (1 + math.exp(-v)) for v in z[bag == d])
            total -= math.log(1 - none) if y else math.log(none)
        return total

    for k, own in enumerate(toxicity.slopes(z, bag, label)):
        step = np.zeros(7)
        step[k] = 1e-6
        assert abs(own - (loss(z + step) - loss(z - step)) / 2e-6) < 1e-6


def test_toxicity_scores_equal_a_plain_version(spark):
    r, rows, labels = random.Random(6), [], []
    for i in range(240):
        w = r.choices(WORDS, k=40)
        if i % 4 == 0:
            w[r.randrange(40)] = "scumbag"
        rows.append((i, ". ".join(" ".join(w[k : k + 10]) for k in range(0, 40, 10))))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300, rows[0][1]), (300, rows[0][1])]
    labels += [(1, 0), (2, None), (None, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.learn(docs, marks)
    got = toxicity.score(docs, weights).collect()
    assert len({x.score for x in got if x.id in (0, 300)}) == 1

    def bucket(word, k=None):
        run = word if k is None else word[:k]
        total = sum(ord(c) * int(toxicity._PLACE[j]) for j, c in enumerate(run)) % 2**64
        return int(textnp.mix(np.array([(total + (k or 0)) % 2**64], np.uint64))[0] >> np.uint64(64 - toxicity.BITS))

    table = weights[:-2]
    for x in got[:40]:
        text = rows[[i for i, _ in rows].index(x.id)][1]
        sentences = [[w for w in s.split()] for s in text.split(".")]
        z = [weights[-2] - math.log(len(sentences)) + sum(table[bucket(w)] + sum(table[bucket(w, k)] for k in toxicity.PREFIXES if len(w) >= k) for w in s) for s in sentences]
        every = sum(math.log1p(math.exp(v)) for v in z)
        want = 1 / (1 + math.exp(-weights[-1]) / math.expm1(every))
        assert abs(x.score - want) < 1e-3


def test_language_scores_equal_plain_trigrams(spark):
    en, fr = "the quick brown fox and the lazy dog with this that", "le renard brun et la chienne avec cette une dans"
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else fr).split(), k=30)), "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, DOCS))
    asked = [(0, "the fox et la chienne"), (1, f"{en} {en} {fr} {fr}"), (2, "Zug, DOG! 7")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}

    def score(word, k):
        total, letters = 0.0, [ord(c) for c in word.lower()] + [0]
        for j, c in enumerate(letters):
            one = letters[j - 1] if j >= 1 else 0
            two = letters[j - 2] if j >= 2 else 0
            code = np.array([(two << 42) | (one << 21) | c], dtype=np.uint64)
            total += float(model["logp"][int(textnp.mix(code)[0] >> np.uint64(64 - langid.BITS)), k])
        return total

    for i, text in asked:
        words = re.findall(r"[^\W\d_]+", text)
        scores = np.array([[score(w, k) for k in range(2)] for w in words])
        labels = langid.viterbi(scores, np.array([0]), np.array([len(words)]), langid.SWITCH_PENALTY)
        letters = [sum(len(w) for w, x in zip(words, labels, strict=True) if x == k) for k in range(2)]
        assert got[i].lid_lang == model["langs"][int(np.argmax(letters))]
        assert len(got[i].lid_spans) == 1 + int((labels[1:] != labels[:-1]).sum())


def test_queries_without_sql(spark, tmp_path):
    r, rows, labels = random.Random(2), [], []
    for i in range(120):
        w = r.choices(WORDS, k=30)
        if i % 3 == 0:
            w[r.randrange(30)] = "idiot"
        rows.append((i, " ".join(w) if i % 10 else "same text", "en", "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    crc = lambda i: zlib.crc32(str(i).encode())
    found = langid.op4_query(spark, str(tmp_path)).collect()
    assert len(found) == 123 and all(x.held_out == (x.doc_id is not None and crc(x.doc_id) % 4 == 2) and 0 <= x.score <= 1 for x in found)
    assert {x.lang_pred for x in found} == {"en", "und"} and all((x.lang_pred == "und") == (x.doc_id in (200, 201)) for x in found)
    marked = toxicity.op10_query(spark, str(tmp_path)).collect()
    assert len(marked) == 123 and all(x.held_out == (x.doc_id is not None and crc(x.doc_id) % 3 == 1) and x.predicted == int(x.score >= 0.7) for x in marked)
    dealt = sharding.op5_query(spark, str(tmp_path)).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(dealt) == 123 and {x.law for x in dealt} == {"rows"} and {x.grown_shard for x in dealt} == {None}
    assert all((x.size, x.text_crc32) == (len((text[x.doc_id] or "").encode()) + 1, zlib.crc32((text[x.doc_id] or "").encode())) for x in dealt)
    assert sorted((x.shard, x.slot) for x in dealt) == [(s, k) for s in range(8) for k in range(15 + (s < 3))]
    assert len({x.shard for x in dealt if text[x.doc_id] == "same text"}) == 1


def test_half_of_all_pages_are_empty(spark, tmp_path):
    pages = [(i, f"u{i}", None if i % 4 == 0 else "" if i % 4 == 2 else f"<p>{i}</p>" if i % 3 else "<p>same</p>") for i in range(200)] + [(None, "u", ""), (199, "u199", "<p>199</p>")]
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("salt", F.lit("clash")), path)
    got = sorted((str(x.page_id), x.url, x.record_type, x.refers_to, x.html) for x in warc.read_archives(spark, path).collect())
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    alone = {t: sum((h or "") == t for *_, h in pages) == 1 for t in last}
    want = [(str(i), u, "response", None, h or "") if i == last[h or ""] or alone[h or ""] else (str(i), u, "revisit", last[h or ""], None) for i, u, h in pages]
    assert got == sorted(want)
