"""Lists that belong to a document: expected keys, checkbox groups, artifacts, checks of a case, page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Groups of checkboxes by their names, and what an option reads if it is marked or not.
IDENTIFICATION = ("driver_s_license_no_selected", "passport_no_selected", "other_selected")
MARKED = ("yes", "true", "checked", "selected", "on", "x")
UNMARKED = ("no", "false", "unchecked", "off")
#: The least score of a mark, when a runner-up counts, and the leads that are asked for then and otherwise.
LEAST_MARK, RUNNER_UP, CLEAR_LEAD, LEAD = 0.050, 0.036, 0.020, 0.015
#: Keys that tell a profile, and how many of them it takes.
PROFILE_HINTS = {
    "student_petition_tr": (4, ("ogrenci_no", "tc_kimlik_no", "ad_soyad", "bolum_program", "telefon", "gano", "e_posta", "tamamlanan_kredi", "ogrenci_aciklamasi", "danisman_gorusu")),
    "insurance_incident_en": (3, ("date_of_report", "describe_the_incident", "if_yes_enter_the_witnesses_names_and_contact_info", "police_station", "complainant_name", "statutes")),
}


def logical_keys(fields: DataFrame) -> DataFrame:
    """doc_id, key, ord: the logical names of fields (doc_id, name, ord), each once, at its first place."""
    return fields.groupBy("doc_id", text.logical_name(F.col("name")).alias("key")).agg(F.min("ord").alias("ord"))


def expected_keys(fields: DataFrame, priorities: DataFrame) -> DataFrame:
    """doc_id, key, place: logical keys in the order of ``priorities`` (canonical, priority), then the others as they come; a null priority is none."""
    keys = logical_keys(fields).withColumn("canonical", text.slugify(F.col("key")))
    ranked = keys.join(F.broadcast(priorities), "canonical", "left")
    order = Window.partitionBy("doc_id").orderBy(F.col("priority").asc_nulls_last(), "ord", "key")
    return ranked.select("doc_id", "key", F.row_number().over(order).alias("place"))


def inferred_profile(fields: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """doc_id, profile: by how many hints are among the canonical keys of a document's fields (doc_id, name, label).

    ``aliases`` (alias, canonical) are other spellings, normalised; without them a key is its own slug.
    """
    spelled = F.array("name", F.coalesce("label", F.lit("")), text.logical_name(F.col("name")), text.logical_name(F.coalesce(F.nullif("label", F.lit("")), "name")))
    keys = fields.select("doc_id", F.explode(F.array_distinct(spelled)).alias("key")).where("key <> ''").select("doc_id", text.normalize_text(F.col("key")).alias("alias")).distinct()
    if aliases is not None:
        keys = keys.join(F.broadcast(aliases), "alias", "left")
    else:
        keys = keys.withColumn("canonical", F.lit(None).cast("string"))
    own = keys.groupBy("doc_id").agg(F.collect_set(F.coalesce("canonical", F.replace("alias", F.lit(" "), F.lit("_")))).alias("keys"))
    profile = F.lit(None).cast("string")
    for name, (least, hints) in PROFILE_HINTS.items():
        profile = F.coalesce(profile, F.when(F.size(F.array_intersect("keys", F.array(*map(F.lit, hints)))) >= least, name))
    return own.select("doc_id", F.coalesce(profile, F.lit("generic_printed_form")).alias("profile"))


def checkbox_group(name: Column) -> Column:
    """The group of a checkbox, by the end of its name; null for one without a group."""
    return F.when(name.isin(*IDENTIFICATION), "identification").otherwise(F.nullif(F.regexp_extract(name, "^(.+)_(?:yes|no|am|pm)$", 1), F.lit("")))


def checkbox_choice(name: Column, value: Column) -> Column:
    """Whether a reading marks an option: true, false, or null if it says neither."""
    plain = text.normalize_text(value)
    own = text.normalize_text(F.regexp_replace(name, "_selected$", ""))
    ending = F.array_contains(F.split(plain, " "), F.substring_index(name, "_", -1))
    named = name.endswith("_selected") & (own.contains(plain) | plain.contains(own))
    return F.when(plain == "", False).when(plain.isin(*MARKED), True).when(plain.isin(*UNMARKED), False).when(ending | named, True)


def marked_option(scores: DataFrame) -> DataFrame:
    """doc_id, grp, key: the option of each group (doc_id, grp, key, ord, score) whose mark is dark enough and leads clearly; groups of one have none. Ties go to the first."""
    order = Window.partitionBy("doc_id", "grp").orderBy(F.desc("score"), "ord")
    ranked = scores.select("doc_id", "grp", "key", "score", F.row_number().over(order).alias("place"), F.lead("score").over(order).alias("second")).where("place = 1 and second is not null")
    lead = F.col("score") - F.col("second")
    clear = (F.col("score") >= LEAST_MARK) & (lead >= LEAD) & ~((F.col("second") > RUNNER_UP) & (lead < CLEAR_LEAD))
    return ranked.where(clear).select("doc_id", "grp", "key")


def artifact_ids(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (job_id, kind, seq, ...) with artifact_id: job, kind and the running number within the job."""
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))
    return artifacts.withColumn("artifact_id", F.concat("job_id", F.lit("__"), "kind", F.lit("_"), number.cast("string")))


def page_texts(spans: DataFrame) -> DataFrame:
    """doc_id, page_number, text: the spans (doc_id, page_number, ord, text) of a page in order, with spaces between; blank ones are left out."""
    full = spans.where(F.col("text").rlike(r"(?U)\S"))
    return full.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))


def word_growth(value: Column, candidate: Column) -> Column:
    """How many words a candidate has that a value has not."""
    return F.size(F.array_except(F.filter(F.split(text.normalize_text(candidate), " "), lambda t: t != ""), F.split(text.normalize_text(value), " ")))


def case_checks(checks: DataFrame, values: DataFrame, families: DataFrame) -> DataFrame:
    """case_id, field, kind, expected, actual, matched of each check (case_id, field, expected, kind) against values (case_id, key, value).

    A value matches in its canonical form. A check of kind family matches if the expected member is the first of ``families`` (family, member, ord) that is
    checked. A missing value is blank.
    """
    seen = values.select("case_id", F.col("key").alias("field"), "value")
    plain, name = text.normalize_text(F.col("value")), text.normalize_text(F.col("field"))
    checked = text.canonical_value(F.col("value"), plain, name).isin(*text.CHECKED)
    first = seen.where(checked).join(F.broadcast(families), F.col("field") == F.col("member")).groupBy("case_id", F.col("family").alias("field")).agg(F.min_by("member", "ord").alias("member"))
    joined = checks.join(seen, ["case_id", "field"], "left").join(first, ["case_id", "field"], "left")
    actual = F.when(F.col("kind") == "family", F.coalesce("member", F.lit(""))).otherwise(F.coalesce("value", F.lit("")))
    rows = joined.select("case_id", "field", "kind", "expected", actual.alias("actual"))
    form = lambda c: text.canonical_value(F.col(c), text.normalize_text(F.col(c)), text.normalize_text(F.col("field")))
    return rows.withColumn("matched", F.when(F.col("kind") == "family", F.col("actual") == F.col("expected")).otherwise(form("actual") == form("expected")))


def case_report(results: DataFrame, cases: DataFrame) -> DataFrame:
    """field_match_rate, case_success_rate, confidence, pass_rate and review_rate in one row; cases: case_id, confidence, passed, review_required, and layout_fidelity and render_readability where they were measured, whose means are added. Without rows every rate is 0."""
    per = results.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("hits"))
    all_ = cases.join(per, "case_id", "left")
    scores = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("layout_fidelity", "render_readability") if c in cases.columns]
    rate = lambda top, under: F.coalesce(F.sum(top) / F.nullif(F.sum(under), F.lit(0)), F.lit(0.0))
    success = (F.coalesce("hits", F.lit(0)) == F.coalesce("n", F.lit(0))).cast("int")
    return all_.agg(
        rate("hits", "n").alias("field_match_rate"), rate(success, F.lit(1)).alias("case_success_rate"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
        rate(F.col("passed").cast("int"), F.lit(1)).alias("pass_rate"), rate(F.col("review_required").cast("int"), F.lit(1)).alias("review_rate"), *scores,
    )
