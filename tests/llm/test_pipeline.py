"""The pipeline, stage by stage and whole, against brute force on a small table with nulls, empties, copies and benchmark passages."""

import random
import re
from collections import Counter

import corpus_pipeline
from test_llm import DOCS, WORDS, brute_components

FRENCH = "renard chienne maison fenêtre école garçon toujours jamais beaucoup rivière montagne soleil lumière chaise voiture jardin fleur oiseau château pomme".split()


def fixture():
    r = random.Random(12)
    item = [" ".join(r.choices(WORDS, k=25)), "one two"]
    rows = []
    for i in range(120):
        words = r.choices(FRENCH if i % 3 == 0 else WORDS, k=r.randint(12, 70))
        rows.append([i, words, "fr" if i % 3 == 0 else "en", "hot" if i % 4 else "rare", 1])
    for i in range(15):  # near copies: one word of a long text
        words = rows[i][1] * 3
        rows.append([200 + 2 * i, words, rows[i][2], "hot", 1])
        rows.append([201 + 2 * i, [*words[:-1], "changed"], rows[i][2], "rare", 1])
    for i in range(10):  # exact copies
        rows.append([300 + i, rows[5][1], "en", "hot", 1])
    for i in range(6):  # ten words of a passage, and nine
        rows.append([400 + i, [*rows[i][1][:6], *item[0].split()[3 : 13 - i % 2], "zulu", *rows[i][1][6:9]], "en", "rare", 1])
    rows = [[i, " ".join(w), lang, source, n] for i, w, lang, source, n in rows]
    rows += [[500, None, "en", "hot", None], [501, "", "en", "hot", 0], [502, "12 34 ... !", None, None, 3], [503, rows[7][1] + " omega", None, None, None], [504, " ".join(FRENCH), "fr", None, 1]]
    return [tuple(x) for x in rows], list(enumerate(item))


def windows(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    n = min(10, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set(), words


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows, items = fixture()
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns

    told = stages["language_id"](spark, docs, d)
    want = [x for x in rows if re.search(r"[^\W\d_]", x[1] or "")]
    assert told.columns == columns and sorted(r.doc_id for r in told.collect()) == sorted(x[0] for x in want)

    first = stages["near_duplicates"](spark, told, d)
    groups = brute_components([x[:2] for x in want], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY_PERCENT)
    want = [x for x in want if groups[x[0]][1] == x[0]]
    assert first.columns == columns and sorted(r.doc_id for r in first.collect()) == sorted(x[0] for x in want)

    clean = stages["decontamination"](spark, first, d)
    passages = set().union(*(windows(t)[0] for _, t in items))
    sizes = {len(p) for p in passages}
    hit = lambda w: any(tuple(w[k : k + n]) in passages for n in sizes for k in range(len(w) - n + 1))
    want = [x for x in want if not hit(windows(x[1])[1])]
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want)
    assert not {400, 402, 404} & {x[0] for x in want} and {401, 403, 405} <= {x[0] for x in want}

    drawn = stages["mixing"](spark, clean, d)
    times = Counter(r.doc_id for r in drawn.collect())
    assert drawn.columns == columns and set(times) == {x[0] for x in want} and max(times.values()) <= 2

    for out in (stages["sharding"](spark, drawn, d).collect(), corpus_pipeline.run(spark, d).collect()):
        assert Counter(r.doc_id for r in out) == times
        slots = [sorted(r.slot for r in out if r.shard == s) for s in range(corpus_pipeline.N_SHARDS)]
        assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
        own = {x[0]: x for x in rows}
        assert all((r.size, r.lang, r.source) == (len(own[r.doc_id][1].encode()) + 1, *own[r.doc_id][2:4]) for r in out)


def test_stages_on_an_empty_table(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
