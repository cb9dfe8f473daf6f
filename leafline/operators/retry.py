"""Second readings of fields: which class of key a second reading is for, and whether it replaces the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text

#: What the keys of each class hold.
CONTACT_KEY = r"(?i)\b(phone|fax|tel|telephone|mobile|cell|email|e-mail)\b"
CHOICE_KEY = r"(?i)\b(type|category|status|method|reason|selection|option)\b"
ADDRESS_KEY = r"(?i)\b(address|mailing address|store address)\b"
MONTH = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
NUMERIC_DATE = r"^[0-9]{1,2}([/-])[0-9]{1,2}[/-][0-9]{2,4}$|^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}$"
SHORT_CODE = r"^[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)+\.?$"
CONTACT_LABEL = r"(?i)(phone|fax|tel|telephone|mobile|cell|email|e-mail)\s*:\s*"
STATION_NOISE = ("cr", "pc", "ipc", "ps", "gp", "pp", "form", "year", "police", "station")
PRECISE_KEYS = ("fax", "statutes", "complainant name", "year", "police station")
#: Classes in the order in which they are applied, how many keys of a document each takes (None: all), the kind of source it leaves, and the reason it adds.
CLASSES = (
    ("contact", None, "llm_retry_contact", None),
    ("choice", None, "llm_retry_choice", None),
    ("address", 3, "llm_retry_empty", None),
    ("date", None, "llm_retry_date", "ambiguous_date_family"),
    ("code", 4, "llm_retry_code", "ocr_confusion_risk"),
    ("empty", 3, "llm_retry_empty", None),
    ("status", 2, "llm_retry_empty", None),
    ("precision", 4, "llm_retry_empty", "ocr_confusion_risk"),
)


def _full(value: Column) -> Column:
    return value.rlike(r"(?U)\S")


def _words(value: Column) -> Column:
    return F.filter(F.split(text.squeeze(value), " "), lambda t: t != "")


def is_date_like(value: Column) -> Column:
    plain = text.squeeze(value)
    return plain.rlike(NUMERIC_DATE) | plain.rlike(MONTH)


def is_short_code(value: Column) -> Column:
    plain = text.squeeze(value)
    return (F.length(plain) <= 16) & ~is_date_like(value) & plain.rlike(SHORT_CODE)


def contact_score(value: Column) -> Column:
    """struct: lines, or phone numbers and addresses if they are more; then length."""
    lines = F.size(F.filter(F.split(value, r"\r\n|\r|\n"), _full))
    found = F.regexp_count(value, F.lit(text.PHONE)) + F.regexp_count(value, F.lit(text.EMAIL))
    return F.struct(F.greatest(lines, found).alias("found"), F.length(F.trim(value)).alias("length"))


def station_score(value: Column) -> Column:
    """How much of a value reads like the name of a station: long words count, numbers, single letters and form words count against it."""
    plain = text.normalize_text(value)
    noise = lambda t: t.isin(*STATION_NOISE)
    word = lambda t: t.rlike("^[a-z]+$") & ~noise(t)
    points = lambda t: F.when(word(t) & (F.length(t) >= 4), 2).when(word(t) & (F.length(t) == 3), 1).otherwise(0) - 2 * (t.rlike("^[0-9]+$").cast("int") + (F.length(t) == 1).cast("int") + noise(t).cast("int"))
    score = F.aggregate(_words(plain), F.lit(0), lambda s, t: s + points(t))
    return score + F.when(plain.contains("airport"), 2).otherwise(0)


def overcaptured_choice(value: Column) -> Column:
    """Whether a value holds a row of options rather than the one that was chosen."""
    plain = F.lower(text.squeeze(value))
    n = F.size(_words(value))
    marked = F.concat(F.lit(" "), plain, F.lit(" ")).contains(" x ") | plain.contains(" other")
    return ((n >= 4) & marked) | ((n >= 6) & ~plain.contains(",") & ~plain.contains("."))


#: Words and numbers of a form that stand around a station's name.
STATION_FORM = (r"(?i)\b(?:p\.?\s*s\.?|police station)\b", r"(?i)\b(?:cr\.?\s*p\.?\s*c\.?|ipc|fir|year|form|no\.?)\b", r"\b[0-9]+\b")


def clean_station(value: Column) -> Column:
    """A station's name without the words and numbers of the form around it."""
    out = text.squeeze(value)
    for pattern in STATION_FORM:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ,.\-/]+|[ ,.\-/]+$", "")


def contact_label(value: Column) -> Column:
    """The label that a contact's spelling stands for."""
    plain = F.lower(F.trim(value))
    out = F.when(plain.startswith("phone"), "phone")
    for start, label in (("fax", "fax"), ("tel", "telephone"), ("mobile", "mobile"), ("cell", "cell"), ("email", "email"), ("e-mail", "email")):
        out = out.when(plain.startswith(start), label)
    return out.otherwise(plain)


def contact_lines(transcripts: DataFrame) -> DataFrame:
    """doc_id, label, value: what follows each contact label in a transcript (doc_id, text), distinct values in order on lines of their own."""
    lines = transcripts.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "t"))
    # a mark in front of every label parts the line
    parts = lines.select("doc_id", "line", F.posexplode(F.split(F.regexp_replace("t", CONTACT_LABEL, "\u0001$1\u0002"), "\u0001")).alias("part", "s")).where(F.col("s").contains("\u0002"))
    value = F.regexp_replace(F.substring_index("s", "\u0002", -1), r"^[ \t;,.]+|[ \t;,.]+$", "")
    found = parts.select("doc_id", "line", "part", contact_label(F.substring_index("s", "\u0002", 1)).alias("label"), value.alias("value")).where("value <> ''")
    first = found.groupBy("doc_id", "label", "value").agg(F.min(F.struct("line", "part")).alias("at"))
    return first.groupBy("doc_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))


def precise_value(key: Column, candidate: Column) -> Column:
    """A precise second reading, cleaned as its normalised key asks for."""
    return (
        F.when(key == "comments", F.regexp_replace(candidate, r"(?i)(\bP\.?\s*O\.?\s*Box\s+[0-9]{5})\b", r"$1\0"))
        .when(key == "statutes", similarity.repair_statutes(candidate))
        .when(key == "complainant name", text.strip_role(candidate))
        .when(key == "police station", clean_station(candidate))
        .when(key == "year", text.canonical_year(candidate))
        .otherwise(candidate)
    )


def key_in_class(name: str, key: Column, plain: Column, value: Column) -> Column:
    """Whether a key (and its normalised form) is asked for again under a class, given its value."""
    compact = F.lower(text.squeeze(F.translate(key, ":#", "  ")))
    contact = key.rlike(CONTACT_KEY) & (compact.rlike("^(phone|fax|tel|telephone|mobile|cell|email|e-mail)") | (F.size(_words(compact)) <= 3))
    code = _full(value) & ((plain.isin("company", "supplier", "position") & (F.length(F.trim(value)) <= 16)) | (is_short_code(value) & ~is_date_like(value)))
    return {
        "contact": contact,
        "choice": key.rlike(CHOICE_KEY),
        "address": key.rlike(ADDRESS_KEY),
        "date": plain.contains("date") | is_date_like(value),
        "code": code,
        "empty": ~_full(value),
        "status": plain.contains("termination date"),
        "precision": plain.isin(*PRECISE_KEYS) | ((plain == "comments") & _full(value)),
    }[name]


def takes(name: str, key: Column, plain: Column, value: Column, candidate: Column, borrowed: Column) -> Column:
    """Whether a candidate replaces a value under a class; never a blank one. ``borrowed``: it is the value of the field beside."""
    new, old = text.normalize_text(candidate), text.normalize_text(value)
    blank = ~_full(value)
    fills = blank & (new != "") & (new != plain) & ~borrowed
    digits = lambda v: text.digit_count(v)
    names = F.size(F.filter(_words(candidate), lambda t: t.rlike(r"(?U)\p{L}")))
    slashes = lambda v: F.regexp_count(v, F.lit("/"))
    commas = lambda v: F.regexp_count(v, F.lit(","))
    precise = (
        F.when(blank, True).when(new == old, False)
        .when(plain == "fax", digits(candidate) >= digits(value))
        .when(plain == "statutes", slashes(candidate) >= slashes(value))
        .when(plain == "complainant name", names.between(2, 4) & (digits(candidate) == 0) & (F.length(F.trim(candidate)) >= F.greatest(F.lit(6), F.length(F.trim(value)) - 4)))
        .when(plain == "police station", station_score(candidate) >= station_score(value) + 2)
        .when(plain == "year", F.trim(candidate).rlike("^(?:19|20)[0-9]{2}$"))
        .when(plain.contains("comments"), (digits(candidate) > digits(value)) | (F.length(candidate) > F.length(value)))
        .otherwise(False)
    )
    rule = {
        "contact": blank | (contact_score(candidate) > contact_score(value)),
        "choice": blank | (overcaptured_choice(value) & (F.length(F.trim(candidate)) <= F.length(F.trim(value)))),
        "address": blank | (F.size(_words(candidate)) >= F.size(_words(value)) + 2) | (F.length(candidate) >= F.length(value) + 12) | (commas(candidate) > commas(value)),
        "date": F.when(blank, fills).otherwise((new != old) & ((plain.contains("termination date") & ~is_date_like(candidate)) | (is_date_like(value) & is_date_like(candidate)))),
        "code": (new != old) & is_short_code(candidate),
        "empty": fills,
        "status": ((plain == "termination date") & (new == "permanent")) | (blank & ~is_date_like(candidate)),
        "precision": precise,
    }[name]
    return F.coalesce(_full(candidate) & rule, F.lit(False))


def seeded(payload: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, key, ord, value, source_kind, review_reasons: every expected key (doc_id, key, ord) with what was read (doc_id, key, value, source_kind, review_reasons), blanks marked missing_value; other keys after them as they are."""
    both = expected.join(payload, ["doc_id", "key"], "full")
    value = F.coalesce("value", F.lit(""))
    reasons = F.coalesce("review_reasons", F.array().cast("array<string>"))
    missing = F.col("ord").isNotNull() & ~_full(value)
    return both.select("doc_id", "key", "ord", value.alias("value"), F.coalesce("source_kind", F.lit("llm_page")).alias("source_kind"), F.when(missing, F.array_union(reasons, F.array(F.lit("missing_value")))).otherwise(reasons).alias("review_reasons"))


def replaced(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, ord, value, source_kind, review_reasons) after the second readings ``candidates`` (doc_id, key, class, value), class by class.

    A class takes the first keys of a document by ``ord``, as many as it may; dates are asked for only if a document has two. A replaced value loses
    missing_value. One shuffle by document serves all classes. Null values and candidates are blank; of repeated candidates of a key and class the largest counts.
    """
    options = candidates.groupBy("doc_id", "key").agg(F.collect_list(F.struct("class", F.coalesce("value", F.lit("")).alias("value"))).alias("_options"))
    out = rows.join(options, ["doc_id", "key"], "left").withColumns({"value": F.coalesce("value", F.lit("")), "_plain": text.normalize_text(F.col("key"))})
    doc = Window.partitionBy("doc_id")
    key, plain, value = F.col("key"), F.col("_plain"), F.col("value")
    for name, most, kind, reason in CLASSES:
        asked = key_in_class(name, key, plain, value) & F.col("ord").isNotNull()
        out = out.withColumn("_asked", F.coalesce(asked, F.lit(False)))
        own = F.array_max(F.transform(F.filter("_options", lambda o: o["class"] == name), lambda o: o["value"]))  # noqa: B023
        candidate = F.coalesce(precise_value(plain, own) if name == "precision" else own, F.lit(""))
        columns = {"_new": candidate, "_dates": F.collect_set(F.when(plain == "date", text.normalize_text(value))).over(doc)}
        if most is not None:
            columns["_rank"] = F.sum(F.col("_asked").cast("int")).over(doc.orderBy("ord", "key").rowsBetween(Window.unboundedPreceding, 0))
        if name == "date":
            columns["_two"] = F.count_if("_asked").over(doc) >= 2
        out = out.withColumns(columns)
        borrowed = plain.contains("termination date") & is_date_like(F.col("_new")) & F.array_contains("_dates", text.normalize_text(F.col("_new")))
        go = F.col("_asked") & takes(name, key, plain, value, F.col("_new"), borrowed)
        go = go & (F.col("_rank") <= most) if most is not None else go
        go = go & F.col("_two") if name == "date" else go
        out = out.withColumn("_go", go)
        kinds = F.when(key_in_class("contact", key, plain, value), "llm_retry_code").otherwise(kind) if name == "precision" else F.lit(kind)
        reasons = F.array_remove(F.array_union("review_reasons", F.array(F.lit(reason))) if reason else F.col("review_reasons"), "missing_value")
        out = out.withColumns({"source_kind": F.when(F.col("_go"), kinds).otherwise(F.col("source_kind")), "review_reasons": F.when(F.col("_go"), reasons).otherwise(F.col("review_reasons")), "value": F.when(F.col("_go"), F.col("_new")).otherwise(value)})
    return out.select(*rows.columns)
