"""Queries of the engine's own operators over the shared tables, with SQL that other engines run to the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, geometry, text
from ..functions.similarity import text_similarity
from ..operators import assign, dedup, families, identity, layout, repair, review, sampling, scoring, segments
from ..streaming import jobs

NORM = (
    r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(translate({0},'ıİğĞşŞçÇöÖüÜ','iIgGsScCoOuU')),'[^\x00-\x7F]','','g'),"
    r"'([a-zA-Z])([0-9])','\1 \2','g'),'([0-9])([a-zA-Z])','\1 \2','g')),'[^a-z0-9]+',' ','g'))"
)


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text -------------------------------------------------------------------


def norm_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("norm"))


def slugify_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), text.is_semantic_name(F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("semantic"))


def contact_extract(spark, d):
    found = lambda p: F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(1)), "|")
    return _t(spark, d, "documents").select("doc_id", found(text.EMAIL).alias("emails"), found(r"(\+?[0-9][0-9()\-\s]{6,}[0-9])").alias("phones"))


def year_canonical(spark, d):
    orders = _t(spark, d, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yy")))
    return orders.select("o_orderkey", text.canonical_year(shown).alias("year"), F.date_format(text.short_date(shown), "yyyy-MM-dd").alias("day"))


def station_address(spark, d):
    s = _t(spark, d, "supplier")
    value = F.concat_ws(" ", F.lit("Police Station PS"), "s_name", "s_name", F.lit("Illiwas peit"))
    s = s.select("s_suppkey", value.alias("value"), text.normalize_text(value).alias("plain"))
    return s.select("s_suppkey", text.canonical_station(F.col("plain")).alias("station"), text.canonical_address(F.col("plain")).alias("address"))


# --- scoring ----------------------------------------------------------------


def _spread(c):
    """A number from 0 to 99 by a digest of an id."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % 100


def _cases(spark, d):
    """Documents as samples of three expected fields, and a perturbed copy as predictions."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "source", "lang", _spread(F.col("doc_id")).alias("h"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    fields = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("Source").alias("key"), F.col("source").alias("value"), F.lit("text").alias("kind")),
        F.struct(F.lit(1).alias("ord"), F.lit("Long text").alias("key"), F.when(F.col("n") > 1000, "Yes").otherwise("No").alias("value"), F.lit("checkbox").alias("kind")),
        F.struct(F.lit(2).alias("ord"), F.lit("Language").alias("key"), F.col("lang").alias("value"), F.lit("text").alias("kind")),
    )
    expected = docs.select("sample_id", F.inline(fields))
    h = F.col("h")
    predicted = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("source").alias("key"), F.when(h % 5 == 0, F.concat("source", F.lit("x"))).otherwise(F.upper("source")).alias("value"), (h / 100.0).alias("confidence")),
        F.struct(F.lit(1).alias("ord"), F.lit("Long text").alias("key"), F.when(h % 7 == 0, F.lit("")).otherwise(F.when(F.col("n") > 1000, "checked").otherwise("off")).alias("value"), (1 - h / 200.0).alias("confidence")),
        F.struct(F.lit(2).alias("ord"), F.when(h % 4 == 0, F.lit("Tongue")).otherwise(F.lit("LANGUAGE:")).alias("key"), F.col("lang").alias("value"), F.lit(0.5).alias("confidence")),
    )
    return docs, expected, docs.select("sample_id", F.inline(predicted))


def field_scores(spark, d):
    _, expected, predicted = _cases(spark, d)
    scored = scoring.score_fields(expected, predicted, fuzzy=False)
    return scored.select("sample_id", "key", "expected_value", "predicted_value", F.round("confidence", 6).alias("confidence"), "matched", "covered", "status")


def field_scoring_report(spark, d):
    docs, expected, predicted = _cases(spark, d)
    scores = scoring.score_fields(expected, predicted, fuzzy=False)
    samples = docs.select("sample_id", F.col("h").cast("double").alias("c"), (F.col("h") % 3 == 0).alias("review_required")).select("sample_id", (F.col("c") / 100).alias("confidence"), "review_required")
    got = scoring.aggregate_metrics(scoring.sample_metrics(samples, scores), scores)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


def calibration(spark, d):
    _, expected, predicted = _cases(spark, d)
    return scoring.calibration(scoring.score_fields(expected, predicted, fuzzy=False)).select("bucket", "fields", F.round("match_rate", 6).alias("match_rate"))


def issue_counts(spark, d):
    _, expected, predicted = _cases(spark, d)
    scores = scoring.score_fields(expected, predicted, fuzzy=False)
    return scoring.issue_counts(scoring.issues(scores, scoring.unexpected_fields(expected, predicted)))


def _samples(spark, d):
    rows = _t(spark, d, "orders")
    return rows.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 101 / 100.0).alias("match_rate"), (F.col("o_orderkey") % 37 / 36.0).alias("coverage"), (F.col("o_orderkey") % 53 / 52.0).alias("confidence"))


def worst_k(spark, d):
    return sampling.worst_k(_samples(spark, d)).select("sample_id", F.round("match_rate", 6).alias("match_rate"))


def showcase_slots(spark, d):
    return sampling.showcase(_samples(spark, d))


def hash_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", sampling.hash_tenth(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("tenth"))


def stratified_subset(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", F.when(F.col("n_chars") <= 500, "sparse").when(F.col("n_chars") <= 3000, "medium").otherwise("dense")).alias("bucket"))
    return sampling.stratified_subset(docs, "bucket", "doc_id", 50)


# --- review -----------------------------------------------------------------


def gates(spark, d):
    lines = _t(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, "fir").otherwise("funsd_plus")
    metrics = lines.groupBy(name.alias("dataset")).agg(F.avg((F.col("l_quantity") > 10).cast("double")).alias("field_normalized_exact_match"), F.avg((F.col("l_discount") < 0.1).cast("double")).alias("field_coverage"))
    return review.gates(metrics).select("dataset", "metric", F.round("actual", 6).alias("actual"), "least", "passed")


def review_queue(spark, d):
    docs, expected, predicted = _cases(spark, d)
    scores = scoring.score_fields(expected, predicted, fuzzy=False).join(docs.select("sample_id", F.col("lang").alias("dataset")), "sample_id")
    items = _t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("sample_id"), F.lit("Source").alias("key"), F.lit("ocr_confusion_risk").alias("reason"), F.lit(0).alias("ord"))
    return review.manual_queue(scores, items).select("dataset", "sample_id", "field", "reason")


def region_plan(spark, d):
    lines = _t(spark, d, "lineitem")
    targets = lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_key"), (F.col("l_linenumber") % 2 + 1).alias("page_number"), F.when(F.col("l_returnflag") == "R", "date").otherwise("text").alias("kind"), F.when(F.col("l_quantity") < 5, "").otherwise("x").alias("value"), (F.col("l_quantity") / 50).alias("confidence"), F.col("l_tax").alias("density"))
    return review.region_plan(targets.groupBy("doc_id", "field_key", "page_number").agg(F.min("kind").alias("kind"), F.min("value").alias("value"), F.min("confidence").alias("confidence"), F.max("density").alias("density")), ["f1"], 3).select("doc_id", "field_key", "reason", "priority", "rank")


# --- duplicates, segments, families -----------------------------------------


def first_wins_dedup(spark, d):
    docs = _t(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return dedup.keep_first(docs, ["key"], ["doc_id"])


def last_wins_dedup(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("value"))
    return dedup.last_value_first_place(events, ["user_id", "event_type"], "value", "event_id")


def unique_slugs(spark, d):
    return dedup.unique_names(_t(spark, d, "part"), ["p_brand"], "p_partkey", "p_type")


def coalesce_segments(spark, d):
    turns = _t(spark, d, "conversations")
    name = F.when(F.col("turn") == 0, "text").when(F.col("turn") == 1, "text__body").otherwise(F.concat(F.lit("text__body_"), F.col("turn").cast("string")))
    return segments.coalesce_segments(turns.select(F.col("conv_id").alias("doc_id"), name.alias("name"), F.col("text").alias("value"))).select("doc_id", "key", F.md5("value").alias("value"))


def family_resolution(spark, d):
    events = _t(spark, d, "events")
    options = events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"), F.min("event_id").alias("ord"), F.count("*").alias("n"))
    options = options.select(F.col("user_id").alias("doc_id"), F.lit("kind").alias("family"), "ord", F.col("event_type").alias("key"), (F.col("n") % 2 == 0).alias("selected"), F.round("v", 3).alias("confidence"))
    return families.resolve_families(options)


def preferred_value(spark, d):
    events = _t(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("value"), (F.col("event_id") % 11 / 10.0).alias("confidence"))
    return families.preferred(events, ["user_id"])


def best_candidate(spark, d):
    events = _t(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("value"), (F.col("event_id") % 11).cast("double").alias("confidence"))
    return families.best_candidate(events, ["user_id"])


def nearest_context(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.col("event_id").cast("string").alias("text"))
    rare = _t(spark, d, "events").agg(F.min("event_type").alias("t"))
    marked = events.join(F.broadcast(rare), F.col("event_type") == F.col("t"), "left")
    return layout.nearest_previous(marked, ["user_id"], ["at", "event_id"], F.col("t").isNotNull(), "at", 3_600_000_000).select("event_id", "context")


# --- geometry ---------------------------------------------------------------


def _boxes(spark, d):
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    left, top = (k * 37 % 500).cast("double"), (k * 91 % 700).cast("double")
    box = F.struct(F.lit(1).alias("page_number"), left.alias("left"), top.alias("top"), (left + 20 + k % 90).alias("right"), (top + 6 + k % 40).alias("bottom"))
    return p.select(F.floor(k / 50).alias("doc_id"), k.alias("ord"), k.cast("string").alias("name"), box.alias("box"))


def box_overlap(spark, d):
    return layout.overlapping_pairs(_boxes(spark, d)).select("doc_id", "a", "b", F.round("iou", 6).alias("iou"))


def box_distance(spark, d):
    b = _boxes(spark, d)
    other = b.select(F.col("doc_id").alias("d2"), (F.col("ord") - 1).alias("o2"), F.col("box").alias("c"))
    near = b.join(other, (F.col("doc_id") == F.col("d2")) & (F.col("ord") == F.col("o2")))
    return near.select("name", F.round(geometry.center_distance(F.col("box"), F.col("c")), 6).alias("distance"), geometry.font_size(geometry.height(F.col("box")), F.col("ord") % 2 == 0).alias("size"))


# --- identity, confidence, jobs ----------------------------------------------


def routing_strategy(spark, d):
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")
    return identity.routing_strategy(pages.withColumn("chars", F.length("text")))


def text_density(spark, d):
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")
    return identity.text_density(pages).withColumn("density", F.round("density", 6))


def keyword_identity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("plain"))
    fam = identity.family(F.col("plain"))
    return docs.select("doc_id", identity.hits(F.col("plain"), identity.TURKISH).alias("turkish_words"), identity.hits(F.col("plain"), identity.ENGLISH).alias("english_words"), identity.language(identity.hits(F.col("plain"), identity.TURKISH), F.lit(0), identity.hits(F.col("plain"), identity.ENGLISH)).alias("language"), fam.alias("family"), identity.domain(fam, F.col("plain")).alias("domain"))


def code_lookup(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", F.coalesce(text.slugify(F.col("r_name")), F.lit("generic")).alias("profile"))


def confidence_derive(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("pdf_direct", "llm_page", "llm_crop", "other")])
    lines = _t(spark, d, "lineitem")
    reasons = F.when(F.col("l_tax") > 0.04, F.array(F.lit("ocr_confusion_risk"), F.lit("borrowed_neighbor_risk"))).otherwise(F.array(F.lit("expected_empty")))
    own = confidence.derived(F.get(kinds, F.col("l_linenumber") % 4), F.when(F.col("l_quantity") < 3, " ").otherwise("x"), reasons)
    return lines.groupBy("l_orderkey").agg(F.round(confidence.mean(own), 6).alias("mean"), F.round(confidence.mean_positive(own), 6).alias("mean_positive"))


def _job_events(spark, d):
    e = _t(spark, d, "events")
    step = F.col("event_id") % 17
    kind = F.when(step == 0, "failed").when(step == 1, "succeeded").when(step < 6, "running").otherwise("step")
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("event_type").alias("step"))


def job_state(spark, d):
    return jobs.latest(_job_events(spark, d))


# --- similarity, assignment, repair (no SQL) ---------------------------------


def _named_parts(spark, d, n: int):
    """Parts in groups of ``n``, as the fields of a document."""
    return _t(spark, d, "part").select(F.floor(F.col("p_partkey") / n).alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))


def similarity(spark, d):
    """Every name against those of the five parts after it."""
    p = _named_parts(spark, d, 50)
    other = p.select("doc_id", F.col("ord").alias("m"), F.col("name").alias("other"))
    pairs = p.join(other, "doc_id").where("m > ord and m <= ord + 5")
    return pairs.select(F.col("ord").alias("n"), "m", F.round(text_similarity(F.col("name"), F.col("other")), 6).alias("ratio"))


def fuzzy_assign(spark, d):
    """Names of parts as source keys, mapped to their slugs as target fields."""
    p = _named_parts(spark, d, 10)
    values = p.select("doc_id", "ord", F.concat(F.lit("the "), "name").alias("source_key"), F.lit(0.8).alias("confidence"))
    targets = p.select("doc_id", (-F.col("ord")).alias("ord"), F.concat(text.slugify(F.col("name")), F.lit("_"), F.col("ord").cast("string")).alias("name"), F.lit("").alias("label"))
    return assign.map_values(values, targets)


def box_assign(spark, d):
    b = _boxes(spark, d)
    found = b.select("doc_id", "ord", F.concat(F.lit("d"), "name").alias("label"), F.lit(0.9).alias("confidence"), "box")
    return assign.map_boxes(found, b).withColumn("confidence", F.round("confidence", 6))


def text_fit(spark, d):
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws("_", F.lit("note"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("value"))
    boxes = F.array(F.struct(F.lit("").alias("end"), F.lit(22.0).alias("height")), F.struct(F.lit("__body").alias("end"), F.lit(80.0).alias("height")))
    fields = turns.select("doc_id", "key").distinct().select("doc_id", "key", F.inline(boxes)).select("doc_id", F.concat("key", "end").alias("name"), F.lit(258.0).alias("width"), "height")
    return segments.expand_segments(turns, fields)


def rule_pipeline(spark, d):
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("doc_id"), F.posexplode(F.array(F.lit("Phone"), F.lit("E-mail"), F.lit("Police Station"), F.lit("Year"), F.lit("Statutes"))).alias("ord", "source_key"), "source", "n_chars")
    value = F.when(F.col("ord") == 0, F.concat(F.lit("Phone: 0532 123 45"), F.lpad((F.col("n_chars") % 100).cast("string"), 2, "0"), F.lit(" email"))).when(F.col("ord") == 1, F.concat(F.lit("email: "), "source", F.lit("@sampleemail.com"))).when(F.col("ord") == 2, "AIPHOTH").when(F.col("ord") == 3, F.concat(F.lit("1911/"), F.lpad((F.col("n_chars") % 100).cast("string"), 2, "0"))).otherwise("341/325% 09/56/34")
    values = rows.select("doc_id", "ord", "source_key", value.alias("value"), F.lit(0.8).alias("confidence"), F.lit("llm_page").alias("source_kind"), F.array().cast("array<string>").alias("review_reasons"))
    return repair.repair(values).select("doc_id", "ord", "source_key", "value", "confidence", "source_kind", F.array_join("review_reasons", ",").alias("review_reasons"))


QUERIES = {f.__name__: f for f in (
    norm_text, slugify_names, contact_extract, year_canonical, station_address, field_scores, field_scoring_report, calibration, issue_counts,
    worst_k, showcase_slots, hash_split, stratified_subset, gates, review_queue, region_plan, first_wins_dedup, last_wins_dedup, unique_slugs,
    coalesce_segments, family_resolution, preferred_value, best_candidate, nearest_context, box_overlap, box_distance, routing_strategy, text_density,
    keyword_identity, code_lookup, confidence_derive, job_state, similarity, fuzzy_assign, box_assign, text_fit, rule_pipeline,
)}


def _fields(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id"), F.col("event_type"), (F.col("event_id") % 5).alias("r"))


def verification(spark, d):
    from ..operators import verify

    e = _fields(spark, d)
    half = lambda m: F.when(F.col("r") == m, F.lit("")).otherwise(F.col("event_type"))
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    fields = e.select("doc_id", name.alias("name"), F.lit(1).alias("page_number"), F.col("event_type").alias("expected"), F.lit(False).alias("numeric"))
    seen = lambda m: e.select("doc_id", name.alias("name"), F.lit(1).alias("page_number"), half(m).alias("observed"))
    shape = e.groupBy("doc_id").agg(F.lit(0.9).alias("geometry_score"))
    got = verify.verdicts(verify.field_results(fields, seen(0), seen(1)), shape, ["f5", "f11"])
    return got.select("doc_id", *[F.round(c, 6).alias(c) for c in ("source", "output", "overall")], "weak", "critical_failures", "passed")


def borrowed_values(spark, d):
    from ..operators import verify

    e = _fields(spark, d)
    return verify.borrowed_values(e.select("doc_id", F.col("event_id").cast("string").alias("source_key"), F.when(F.col("r") == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).alias("value")))


QUERIES |= {"verification": verification, "borrowed_values": borrowed_values}
