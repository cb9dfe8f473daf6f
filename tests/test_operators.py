import random
import re

from pyspark.sql import functions as F

from leafline.functions import similarity
from leafline.operators import assign, dedup, families, repair, review, sampling, scoring, segments
from leafline.plans import queries
from leafline.sources import manifests
from leafline.streaming import jobs


def test_scoring_report(spark):
    expected = spark.createDataFrame([("a", 0, "Name", "Ada", "text"), ("a", 1, "Approved", "Yes", "checkbox"), ("b", 0, "Name", "Ada", "text"), ("b", 1, "Approved", "Yes", "checkbox")], "sample_id string, ord int, key string, value string, kind string")
    predicted = spark.createDataFrame([("a", 0, "name", "Ada", 0.9), ("a", 1, "Approved", "checked", 0.9), ("b", 0, "Name", "Grace", 0.4), ("b", 1, "Other", "x", 0.4)], "sample_id string, ord int, key string, value string, confidence double")
    samples = spark.createDataFrame([("a", 0.93, False), ("b", 0.40, True), ], "sample_id string, confidence double, review_required boolean")
    scores = scoring.score_fields(expected, predicted)
    got = scoring.aggregate_metrics(scoring.sample_metrics(samples, scores), scores).first()
    assert (got.field_match, got.field_coverage, got.document_success, round(got.mean_confidence, 6)) == (0.5, 0.75, 0.5, 0.665)
    assert {(r.code, r.n) for r in scoring.issue_counts(scoring.issues(scores, scoring.unexpected_fields(expected, predicted))).collect()} == {("benchmark.missing_field", 1), ("benchmark.unexpected_field", 1)}
    assert scoring.calibration(scores).count() == 5


def test_name_scoring(spark):
    rows = [("Complainant Name", "Dipankar Sardar", "Aipankar Sardat", True), ("Complainant Name", "Bijoy Saha", "Bitex Saha", True), ("Year", "2018", "1911/18", True), ("Statutes", "341/325/307/506/34 Ipc", "341/325/307/506/34", True), ("Complainant Name", "Ada Lovelace", "Grace Hopper", False)]
    expected = spark.createDataFrame([(i, 0, k, e, "text") for i, (k, e, _, _) in enumerate(rows)], "sample_id int, ord int, key string, value string, kind string")
    predicted = spark.createDataFrame([(i, 0, k, p, 0.5) for i, (k, _, p, _) in enumerate(rows)], "sample_id int, ord int, key string, value string, confidence double")
    got = {r.sample_id: r.matched for r in scoring.score_fields(expected, predicted).collect()}
    assert got == {i: m for i, (_, _, _, m) in enumerate(rows)}


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3 if i < 6 else 0]) for i in range(9)], "id int, bucket string")
    assert [r.id for r in sampling.stratified_subset(rows, "bucket", "id", 5).collect()] == [0, 1, 2, 3, 4]
    import hashlib

    names = [f"n{i}" for i in range(200)]
    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", sampling.hash_tenth(F.col("n")).alias("t")).collect()}
    assert got == {n: int(hashlib.md5(n.encode()).hexdigest(), 16) % 10 for n in names}


def test_unique_names_equal_the_fold_in_order(spark):
    r = random.Random(7)
    rows = [(g, k, r.choice(["x", "X 2", "x 2 2", "y", "y", "z 3", None, "x-3"])) for g in ("a", "b", None) for k in range(25)]
    want = set()
    for g in ("a", "b", None):
        taken = []
        for _, k, label in [x for x in rows if x[0] == g]:
            slug = (label or "field").lower().replace(" ", "_").replace("-", "_")
            name = slug if slug not in taken else next(f"{slug}_{i}" for i in range(2, 99) if f"{slug}_{i}" not in taken)
            taken.append(name)
            want.add((g, k, name))
    frame = spark.createDataFrame(rows, "g string, k int, label string")
    assert {tuple(x) for x in dedup.unique_names(frame, ["g"], "k", "label").collect()} == want
    assert dedup.unique_names(frame.limit(0), ["g"], "k", "label").count() == 0


def test_unnamed_samples_are_numbered_over_all_partitions(spark):
    rows = spark.range(0, 40, 1, 5).selectExpr("if(id % 4 = 0, 'named', if(id % 4 = 1, '', null)) as sample_id", "cast(null as string) as split", "cast(null as int) as page_number")
    rows = rows.selectExpr("*", f"cast(null as {manifests.PAGE}) as page", f"cast(null as array<{manifests.PAGE}>) as pages", f"cast(null as array<{manifests.FIELD}>) as expected_fields")
    got = [x.sample_id for x in manifests.manifest_samples(rows, "d").collect()]
    assert got.count("named") == 10 and sorted(x for x in got if x != "named") == sorted(f"d:test:{k}" for k in range(30))


def test_unique_slugs(spark):
    row = spark.createDataFrame([(["x", "x", "x_2", "X"],)], "labels array<string>").select(dedup.unique_slugs(F.col("labels")).alias("s")).first()
    assert row.s == ["x", "x_2", "x_2_2", "x_3"]


def test_families_and_preference(spark):
    options = spark.createDataFrame([("d", "f", 0, "am", True, 0.6), ("d", "f", 1, "pm", True, 0.9), ("e", "f", 0, "am", False, 0.5)], "doc_id string, family string, ord int, key string, selected boolean, confidence double")
    got = {(r.doc_id, r.key): (r.value, r.reason) for r in families.resolve_families(options).collect()}
    assert got == {("d", "am"): ("", "expected_empty"), ("d", "pm"): ("yes", "field_family_conflict"), ("e", "am"): ("", "expected_empty")}
    values = spark.createDataFrame([("k", 0, "abc", 0.5), ("k", 1, "abcd", 0.46), ("k", 2, "ab", 0.50)], "key string, ord int, value string, confidence double")
    assert families.preferred(values, ["key"]).first().value == "abcd"


def test_mapping(spark):
    values = spark.createDataFrame([("d", 0, "Student Number", 0.9), ("d", 1, "Email Address", 0.9)], "doc_id string, ord int, source_key string, confidence double")
    targets = spark.createDataFrame([("d", 0, "e_posta", ""), ("d", 1, "ogrenci_no", "")], "doc_id string, ord int, name string, label string")
    aliases = F.create_map(F.lit("student number"), F.lit("ogrenci_no"), F.lit("email address"), F.lit("e_posta"))
    got = {r.source_key: (r.target_field, r.status) for r in assign.map_values(values, targets, aliases).collect()}
    assert got == {"Student Number": ("ogrenci_no", "mapped"), "Email Address": ("e_posta", "mapped")}


def test_mapping_of_many_names(spark, monkeypatch):
    """A row a value, also where keys repeat, as a plain loop over all pairs takes them; few pairs are compared in full."""
    words = ["pale", "steel", "linen", "almond", "blue", "misty"]
    names = [f"{words[i % 6]} {words[i * 5 % 4]}" for i in range(12)]
    values = [("d", i, f"the {names[i]}" if i != 5 else "!", 0.5) for i in range(12)]
    targets = [("d", -i, f"{names[i].replace(' ', '_')}_{i}", "" if i % 3 else f"Label {names[i]}") for i in range(12)]
    v = spark.createDataFrame([*values, ("e", 0, "alone", 0.5)], "doc_id string, ord int, source_key string, confidence double")
    t = spark.createDataFrame(targets, "doc_id string, ord int, name string, label string")
    got = sorted((r.source_key, r.target_field, round(r.confidence, 9)) for r in assign.map_values(v, t).collect())
    plain = lambda x: " ".join(re.sub("[^a-z0-9]+", " ", re.sub("([0-9]+)", r" \1 ", x.lower())).split())
    free, want = sorted(targets, key=lambda x: x[1]), [("alone", "", 0.0)]
    for _, _, key, trust in values:
        score, target = max(((max(similarity.ratio(plain(key), plain(x)) for x in (t[3] or t[2], t[2])), t) for t in free), key=lambda x: x[0])
        want.append((key, target[2] if score else "", round((score + trust) / 2, 9) if score else 0.0))
        free = [t for t in free if not score or t != target]
    assert got == sorted(want)
    seen = []
    monkeypatch.setattr(similarity, "ratio", lambda a, b, ratio=similarity.ratio: seen.append((a, b)) or ratio(a, b))
    value = {"ord": 0, "source": "x", "plain": "the pale linen", "own": "the pale linen"}
    assert assign._best_name([value], [{"target": x, "label": x, "name": x, "own_label": x, "own_name": x} for x in ("blue", "pale linen 3", "misty steel", "zz")])(0, set())[1] == 1
    assert seen == [("the pale linen", "pale linen 3")]


def test_boxes_of_one_label_take_a_row_each(spark):
    box = "struct<page_number:int,left:double,top:double,right:double,bottom:double>"
    found = [("d", 0, "x", 0.9, (1, 0.0, 0.0, 10.0, 10.0)), ("d", 1, "x", 0.9, (1, 50.0, 0.0, 60.0, 10.0)), ("d", 2, "y", 0.9, (2, 0.0, 0.0, 10.0, 10.0)), ("d", 3, "z", 0.9, (1, 1.0, 0.0, 11.0, 10.0)), ("e", 0, "x", 0.9, (1, 0.0, 0.0, 10.0, 10.0))]
    fields = [("d", 0, "a", (1, 52.0, 0.0, 62.0, 10.0)), ("d", 1, "b", (1, 0.0, 0.0, 10.0, 10.0)), ("d", 2, "c", None)]
    got = assign.map_boxes(spark.createDataFrame(found, f"doc_id string, ord int, label string, confidence double, box {box}"), spark.createDataFrame(fields, f"doc_id string, ord int, name string, box {box}")).collect()
    assert sorted((r.doc_id, r.source_key, r.target_field, r.status) for r in got) == [("d", "x", "a", "mapped"), ("d", "x", "b", "mapped"), ("d", "y", "", "unmapped"), ("d", "z", "", "unmapped"), ("e", "x", "", "unmapped")]
    assert {round(r.confidence, 6) for r in got} == {0.95, 0.0, round((0.7 * 8 / 12 + 0.3 * (1 - 2 / 200**0.5) + 0.9) / 2, 6)}


def test_segments(spark):
    values = spark.createDataFrame([("d", "a__body_2", "three"), ("d", "a", "one"), ("d", "a__body", "two"), ("d", "b", "")], "doc_id string, name string, value string")
    assert [tuple(r) for r in segments.coalesce_segments(values).collect()] == [("d", "a", "one\ntwo\nthree")]


def plain_fit(value, boxes):
    """Texts in boxes of (width, height), one character after the other."""
    best = ([], value.split(), [])
    for char in (6.2, 5.8, 5.4, 5.0, 4.6):
        counts = [1 if h <= 26 else 2 if h <= 44 else max(2, int((h + 2) // 20)) for _, h in boxes]
        rooms = [max(1, int(max(12.0, w - 8) * max(0.9, min(1.0, 6 / char)) / ((9.6 if n > 1 else 10.5) / 2))) for (w, _), n in zip(boxes, counts, strict=True) for _ in range(n)]
        rest, lines = "\n".join(" ".join(p.split()) for p in value.splitlines() if p.strip()), []
        for room in rooms:
            paragraph, at = rest.split("\n")[0], 0
            ends = [k for k in range(len(paragraph) + 1) if k <= room and (k == len(paragraph) or paragraph[k] == " ")]
            at = max(ends) if ends and max(ends) > 0 else min(room, len(paragraph))
            lines.append(paragraph[:at])
            rest = rest[at:].lstrip(" \n")
        if not rest:
            break
    if rest and lines:
        room = rooms[-1] - 3
        window = lines[-1][:room].rstrip() if room > 0 else ""
        if room > 0 and len(lines[-1]) > room and " " in window and window.rindex(" ") >= max(1, len(window) // 2):
            window = window[: window.rindex(" ")].rstrip()
        lines[-1] = window + "..."
    parts, at = [], 0
    for n in counts:
        parts.append("\n".join(x for x in lines[at : at + n] if x))
        at += n
    return parts, rest.replace("\n", " ")


def test_fit_equals_a_plain_version(spark):
    r = random.Random(4)
    words = ["a", "bb", "longer", "x" * 40, "y" * 90, "the", "\n"]
    rows = [(k, " ".join(r.choices(words, k=r.randrange(0, 50))), [(float(r.choice([20, 110, 258])), float(r.choice([22, 36, 80]))) for _ in range(r.randrange(1, 4))]) for k in range(120)]
    rows += [(900, "word " * 200, [(110.0, 22.0), (258.0, 36.0)]), (901, "a few short words", [(160.0, 22.0), (310.0, 22.0)]), (902, "", [(160.0, 22.0)])]
    df = spark.createDataFrame(rows, "k int, v string, b array<struct<width:double,height:double>>")
    got = {x.k: (x.f.parts, x.f.overflow) for x in df.select("k", segments.fit(F.col("v"), F.col("b")).alias("f")).collect()}
    assert all(got[k] == plain_fit(v, b) for k, v, b in rows)
    parts, over = got[900]
    assert over and "..." in parts[1] and parts[1].count("\n") <= 1
    assert got[901][1] == "" and " ".join(p for p in got[901][0] if p) == "a few short words"
    assert spark.range(1).select(segments.fit(F.lit("left over"), F.expr("array_repeat(named_struct('width', 1d, 'height', 1d), 0)")).alias("f")).first().f == ([], "left over")


def test_text_fit_takes_every_turn(spark, tmp_path):
    turns = [(1, 0, "hello there"), (1, 1, "word " * 100), (1, 2, "a third turn"), (1, 11, ""), (2, 0, "two\nlines of text"), (2, 3, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for conv, turn, value in turns:
        parts, over = plain_fit(value or "", [(258.0, 22.0), (258.0, 80.0)])
        want += [(conv, f"note_{turn}", parts[0], over), (conv, f"note_{turn}__body", parts[1], over)]
    assert sorted(tuple(r) for r in queries.text_fit(spark, str(tmp_path)).collect()) == sorted(want)


def test_repairs(spark):
    rows = [("d", "Company", "M/A/R/C"), ("d", "Supplier", "M/A/R/C"), ("e", "date_of_report", "October 27, 2024"), ("e", "report_year", "2020"), ("f", "Offer Complete", "08/15/98"), ("f", "Expiration Date", "06/15/98"), ("g", "witness contact info", "Witness 1: Rob Chen, 518-555-1112. Witness 2: Keisha Long, 518-555-1112"),
            ("p", "telefon", "0532 123 4567 / a.yilmaz@email.com"), ("p", "e_posta", ""), ("p", "ogrenci_no", "Ogrenci No: 20241001"), ("p", "gano", "GANO: 3,45")]
    values = spark.createDataFrame([(d, i, k, v, 0.8, "llm_page", []) for i, (d, k, v) in enumerate(rows)], "doc_id string, ord int, source_key string, value string, confidence double, source_kind string, review_reasons array<string>")
    got = {(r.doc_id, r.source_key): r.value for r in repair.repair(values).collect()}
    assert got["d", "Company"] == "MIA/R/C" and got["d", "Supplier"] == "WWA/R/C"
    assert got["e", "date_of_report"] == "October 27" and got["e", "report_year"] == "24"
    assert got["f", "Offer Complete"] == "06/15/98"
    assert got["g", "witness contact info"] == "Witness 1: Rob Chen, 518-555-1112. Witness 2: Keisha Long"
    assert got["p", "telefon"] == "0532 123 4567" and got["p", "e_posta"] == "a.yilmaz@email.com"
    assert got["p", "ogrenci_no"] == "20241001" and got["p", "gano"] == "3.45"


def test_station_compares_every_word(spark):
    long = "main north gate terminal building central district "
    rows = [("Police Station", long + "Aiphoth"), ("Police Station", long * 20 + "no 7 aiphoth"), ("Police Station", long + "harbour"), ("Police Station", "AIPHOTH"), ("Notes", long + "Aiphoth"), ("Station", None)]
    values = spark.createDataFrame([(str(i), 0, k, v, 0.8, "llm_page", []) for i, (k, v) in enumerate(rows)], "doc_id string, ord int, source_key string, value string, confidence double, source_kind string, review_reasons array<string>")
    got = {int(r.doc_id): r.value for r in repair.repair(values).collect()}
    assert [got[i] for i in (0, 1, 3)] == ["Airport"] * 3
    assert got[2].endswith("harbour") and got[4].endswith("Aiphoth") and got[5] == ""


def test_gates(spark):
    metrics = spark.createDataFrame([("fir", 0.8, 0.5)], "dataset string, field_normalized_exact_match double, field_coverage double")
    assert {(r.metric, r.passed) for r in review.gates(metrics).collect()} == {("field_normalized_exact_match", True), ("field_coverage", False)}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"sample_id": "s", "pages": [{"page_number": 1}, {"page_number": 2, "expected_fields": [{"key": "b", "value": "2"}, {"key": "b", "value": "3"}]}], "expected_fields": [{"key": "a", "value": "1", "kind": "date"}]}]')
    fields = manifests.manifest_fields(manifests.read_manifest(spark, str(tmp_path / "m.json"), "x"))
    assert {(r.key, r.page_number, r.value, r.kind) for r in fields.collect()} == {("a", 1, "1", "date"), ("b", 2, "3", "text")}


def test_file_kinds(spark):
    rows = [(b"%PDF-1.7",), (b"\x89PNG\r\n\x1a\n",), (b' {"a": 1}',), (b"",), (b"RIFF1234WEBP",)]
    assert [r.k for r in spark.createDataFrame(rows, "content binary").select(manifests.file_kind(F.col("content")).alias("k")).collect()] == ["pdf", "png", "json", "unknown", "webp"]


def test_jobs(spark):
    events = spark.createDataFrame([("a", 0, "created", ""), ("a", 1, "running", ""), ("a", 2, "step", "x"), ("a", 3, "step", "x"), ("a", 4, "succeeded", ""), ("a", 5, "running", ""), ("b", 0, "created", "")], "job_id string, seq long, event string, step string")
    got = {r.job_id: (r.status, r.last_seq, r.steps) for r in jobs.latest(events).collect()}
    assert got == {"a": ("succeeded", 4, 1), "b": ("queued", 0, 0)}


def test_job_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("a", 0, "created", ""), ("a", 1, "running", ""), ("a", 2, "step", "x"), ("a", 4, "succeeded", ""), ("b", 0, "created", "")], "job_id string, seq long, event string, step string")
    events.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = jobs.track(stream).writeStream.outputMode("update").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.job_id: (r.status, r.last_seq, r.steps) for r in spark.table("tracked").collect()}
    assert got == {r.job_id: (r.status, r.last_seq, r.steps) for r in jobs.latest(events).collect()}
