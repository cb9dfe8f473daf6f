"""Ordered repairs of extracted field values, as column expressions over a long table.

Rows: doc_id, ord, source_key, value, confidence, source_kind, review_reasons. A rule sees what the rules
before it left. Rules that look at one field are expressions on its row; rules
that look at two read the other through a window over the document's few fields.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..sources.tables import discard, spread, written


def _v() -> Column:
    return F.col("value")


def _key() -> Column:
    return F.col("nk")


def _petition_key() -> Column:
    """The key in a petition, null elsewhere."""
    return F.when(F.col("_petition"), F.col("nk"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _doc():
    return Window.partitionBy("doc_id")


PHONE_WORDS = ("phone", "tel", "telephone", "mobile", "cell")
#: Keys of a student petition, three of which reveal one.
PETITION_KEYS = ("ogrenci no", "tc kimlik no", "ad soyad", "bolum program", "telefon", "gano", "e posta", "tamamlanan kredi", "ogrenci aciklamasi", "danisman gorusu")
#: Labels that stray into a petition's fields.
PETITION_LABELS = {
    "ad soyad": ("ad soyad", "adi soyadi", "first last name", "name surname"),
    "bolum program": ("bolum program", "department programme", "department program"),
    "telefon": ("cep telefon no", "telefon", "gsm number", "phone"),
    "e posta": ("e posta adresi", "e posta", "email address", "e mail address"),
    "ogrenci aciklamasi": ("ogrencinin aciklamasi", "student explanation", "student s explanation"),
    "danisman gorusu": ("ogretim uyesi danisman gorusu", "danisman gorusu", "advisor opinion", "advisor review"),
    "ders kodu": ("ders kodu", "course code"),
    "ders adi": ("dersin adi", "course name"),
}


#: Families of checkboxes: each option, the field of its value, and a field that is empty if it is selected.
FAMILIES = (
    (("driver s license no selected", "driver s license no", None), ("passport no selected", "passport no", None), ("other selected", "other", None)),
    (("time am", None, None), ("time pm", None, None)),
    (("was anyone injured yes", None, None), ("was anyone injured no", None, "if yes describe the injuries")),
    (("were there witnesses to the incident yes", None, None), ("were there witnesses to the incident no", None, "if yes enter the witnesses names and contact info")),
)


def has(*words: str) -> Column:
    return reduce(lambda a, w: a | _key().contains(w), words[1:], _key().contains(words[0]))


def cell(key: str, what: Column | None = None) -> Column:
    """A column of the document's field with this normalised key (the first, if it comes twice); null without one."""
    return F.min_by(F.when(_key() == key, F.struct((_v() if what is None else what).alias("x"))), F.when(_key() == key, F.col("ord"))).over(_doc())["x"]


def update(rows: DataFrame, new: Column, when: Column, add: tuple[str, ...] = (), drop: tuple[str, ...] = (), kind: str | None = "rule_compound", support: Column | None = None) -> DataFrame:
    """Rows with ``new`` where ``when`` holds and the value changes: source kind, confidence (least positive of the support) and reasons follow."""
    go = F.coalesce(when & (new != _v()), F.lit(False))
    reasons = F.array_union(F.array_except("review_reasons", F.array(*map(F.lit, drop)) if drop else _none()), F.array(*map(F.lit, add)) if add else _none())
    marked = rows.withColumns({"_go": go, "_new": new, "_low": support if support is not None else F.col("confidence")})
    changed = {"value": F.when(F.col("_go"), F.col("_new")).otherwise(_v()), "review_reasons": F.when(F.col("_go"), reasons).otherwise(F.col("review_reasons"))}
    if kind:
        changed |= {"source_kind": F.when(F.col("_go"), F.lit(kind)).otherwise(F.col("source_kind")), "confidence": F.when(F.col("_go") & (F.col("_low") > 0), F.col("_low")).otherwise(F.col("confidence"))}
    return marked.withColumns(changed).drop("_go", "_new", "_low")


def _strip(value: Column, chars: str) -> Column:
    return F.regexp_replace(value, f"^[{chars}]+|[{chars}]+$", "")


def _code(value: Column) -> Column:
    plain = text.normalize_text(value)
    return F.when(plain == "mia r c", "mia").when(plain == "wwa r c", "wwa").when(plain == "m a r c", "unclear").otherwise(plain)


def _positive(*cells: Column) -> Column:
    return F.least(*[F.when(c > 0, c) for c in cells])


def _petition_contacts(rows: DataFrame) -> DataFrame:
    phone, mail = text.first_phone(_v()), text.first_email(_v())
    other_mail, other_phone = cell("telefon", text.first_email(_v())), cell("e posta", F.regexp_extract(_v(), text.PHONE, 1))
    both = _positive(cell("telefon", F.col("confidence")), cell("e posta", F.col("confidence")))
    rows = update(rows.withColumns({"_m": other_mail, "_p": other_phone}), F.when(_petition_key() == "e posta", F.col("_m")).otherwise(F.col("_p")), _petition_key().isin("e posta", "telefon") & (F.trim(_v()) == "") & F.when(_petition_key() == "e posta", F.col("_m") != "").otherwise(F.col("_p") != ""), support=both).drop("_m", "_p")
    rows = update(rows, phone, (_petition_key() == "telefon") & F.regexp_like(_v(), F.lit(text.PHONE)))
    return update(rows, mail, (_petition_key() == "e posta") & (mail != ""))


def _codes(rows: DataFrame) -> DataFrame:
    company, supplier = cell("company", _code(_v())), cell("supplier", _code(_v()))
    rows = rows.withColumns({"_c": company, "_s": supplier})
    rows = update(rows, F.lit("MIA/R/C"), (_key() == "company") & (F.col("_c") == "unclear") & F.col("_s").isin("unclear", "wwa"), ("ocr_confusion_risk",), kind=None)
    return update(rows, F.lit("WWA/R/C"), (_key() == "supplier") & (F.col("_s") == "unclear") & F.col("_c").isin("unclear", "mia"), ("ocr_confusion_risk",), kind=None).drop("_c", "_s")


def _contacts(rows: DataFrame) -> DataFrame:
    rows = update(rows, F.regexp_replace(F.regexp_replace(_v(), r"(?iU)\s+(?:e|e-|email|e mail)\s*$", ""), "[ -]+$", ""), has(*PHONE_WORDS))
    return update(rows, F.regexp_replace(F.regexp_replace(_v(), r"(?iU)\s+(?:none|null)\s*$", ""), "[ :-]+$", ""), ~has(*PHONE_WORDS) & has("contact info"))


def _bleed(rows: DataFrame) -> DataFrame:
    mail = F.coalesce(F.nullif(text.first_email(_v()), F.lit("")), text.strip_label(_v(), ("e-mail", "email", "e mail")))
    home = F.regexp_replace(text.strip_label(_v(), ("address",)), r"(?iU)\s+(?:phone|e[- ]?mail|email)\b.*$", "")
    papers = text.strip_label(_v(), ("identification", "driver's license no", "drivers license no", "driver license no", "passport no", "other"))
    clean = F.when(has(*PHONE_WORDS), text.first_phone(_v())).when(has("email", "e mail"), mail).when(has("address"), home).when(has("driver s license", "passport", "identification", "other"), papers).otherwise(F.trim(_v()))
    return update(rows, _strip(clean, " :-"), F.trim(_v()) != "")


def _witnesses(rows: DataFrame) -> DataFrame:
    value = text.squeeze(_v())
    found = F.regexp_extract_all(value, F.lit(r"(?<![0-9])(\+?[0-9][0-9()\-\s]{6,}[0-9])"), F.lit(1))
    one, two = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    first_end = F.instr(value, one) + F.length(one)
    at = F.position(two, value, first_end)
    second = F.position(F.lit("witness"), F.lower(value), F.instr(F.lower(value), "witness") + 1)
    cut = F.concat(F.substring(value, F.lit(1), at - 1), F.substring(value, at + F.length(two), F.length(value)))
    clean = F.regexp_replace(F.regexp_replace(_strip(cut, " ,.;"), r"\s{2,}", " "), r"\s+([,.;])", "$1")
    same = (F.size(found) >= 2) & (text.normalize_text(one) == text.normalize_text(two)) & (F.regexp_count(value, F.lit(r"(?i)witness\s*[0-9]+\s*:")) >= 2) & (at >= second)
    return update(rows, clean, has("contact info", "witnesses") & same, ("ocr_confusion_risk",))


def _stations(rows: DataFrame) -> DataFrame:
    plain = text.normalize_text(_v())
    station = _key().endswith("station") & (plain != "")
    close = similarity.closest_word(F.when(station, plain), "airport")
    return update(rows, F.lit("Airport"), station & (plain.contains("airport") | (close >= 0.68)), ("ocr_confusion_risk",))


def _dates(rows: DataFrame) -> DataFrame:
    offer, due = cell("offer complete", text.short_date(_v())), cell("expiration date", text.short_date(_v()))
    rows = rows.withColumns({"_o": offer, "_e": due})
    moved = F.date_format(F.make_date(F.year("_o"), F.month("_e"), F.day("_o")), "MM/dd/yy")
    apart = (F.year("_o") == F.year("_e")) & (F.day("_o") == F.day("_e")) & (F.abs(F.month("_o") - F.month("_e")) > 1)
    rows = update(rows, moved, (_key() == "offer complete") & apart, ("ambiguous_date_family",), kind=None).drop("_o", "_e")
    rows = rows.withColumns({"_o": cell("offer complete", text.short_date(_v())), "_e": cell("expiration date", text.short_date(_v()))})
    later = F.date_format(F.date_add("_e", 1), "MM/dd/yy")
    return update(rows, later, (_key() == "expiration date") & (F.col("_o") == F.col("_e")) & F.array_contains("review_reasons", "ambiguous_date_family"), ("ambiguous_date_family",), kind=None).drop("_o", "_e")


def _report_year(rows: DataFrame) -> DataFrame:
    both = _positive(cell("date of report", F.col("confidence")), cell("report year", F.col("confidence")))
    rows = rows.withColumns({"_d": cell("date of report"), "_y": cell("report year"), "_b": both})
    year = text.report_year(F.col("_d"))
    suffix = F.right(F.when(year != "", year).otherwise(text.year_field(F.col("_y"))), F.lit(2))
    known = F.col("_d").isNotNull() & F.col("_y").isNotNull()
    trimmed = text.without_report_year(F.col("_d"))
    rows = update(rows, trimmed, (_key() == "date of report") & known & (year != "") & (trimmed != ""), support=F.col("_b"))
    return update(rows, suffix, (_key() == "report year") & known & (suffix != ""), drop=("missing_value",), support=F.col("_b")).drop("_d", "_y", "_b")


def _families(rows: DataFrame) -> DataFrame:
    """Families of checkboxes: one option stays, the others and what belongs to them are emptied.

    Of several selected options the one with the highest confidence wins, ties to the first. An option's value is kept if its option wins,
    unless it only repeats the option's name. Only the first field of a repeated key takes part. One window gives each row its family's few fields.
    """
    place = {key: 16 * f + 3 * k + r for f, family in enumerate(FAMILIES) for k, keys in enumerate(family) for r, key in enumerate(keys) if key}
    code = F.try_element_at(F.from_json(F.lit(json.dumps(place)), "map<string,int>"), _key())
    own, at = F.col("confidence"), F.col("_code") % 16
    selected = F.when(at % 3 == 0, text.checkbox_state(text.normalize_text(_v())) == "true")
    member = F.struct(at.alias("at"), F.col("ord").alias("ord"), F.coalesce(selected, F.lit(False)).alias("selected"), own.alias("c"))
    rows = rows.withColumn("_code", code).withColumn("_family", F.floor(F.col("_code") / 16).cast("int"))
    rows = spread(rows, "doc_id", "_family").withColumn("_all", F.collect_list(F.when(F.col("_code").isNotNull(), member)).over(Window.partitionBy("doc_id", "_family")))
    earlier = lambda i, o: F.exists("_all", lambda y: (y["at"] == i) & (y["ord"] < o))
    rows = rows.withColumns({"_options": F.filter("_all", lambda x: (x["at"] % 3 == 0) & ~earlier(x["at"], x["ord"])), "_place": F.when(F.col("_code").isNotNull() & ~earlier(at, F.col("ord")), at)})
    option, seen = F.floor(F.col("_place") / 3), F.col("_options")
    chosen, mine = F.filter(seen, lambda x: x["selected"]), F.filter(seen, lambda x: x["at"] == option * 3)
    trust = lambda xs: F.transform(xs, lambda x: x["c"])
    rows = rows.withColumns({
        "_n": F.size(chosen),
        "_best": F.array_max(F.transform(chosen, lambda x: F.struct(x["c"].alias("c"), (-F.floor(x["at"] / 3)).alias("o")))),
        "_low": F.array_min(trust(F.filter(seen, lambda x: x["c"] > 0))),
        "_mine": F.array_max(trust(mine)),
        "_there": F.size(mine) > 0,
    })
    role = F.get(F.array(*map(F.lit, ("option", "value", "emptied"))), F.col("_place") % 3)
    wins, conflict = F.coalesce(option == -F.col("_best.o"), F.lit(False)), F.col("_n") > 1
    name = F.regexp_replace(_key(), " (selected|yes|no)$", "")
    noise = (text.normalize_text(_v()) != "") & text.normalize_text(_v()).isin(_key(), name)
    ruled = F.coalesce((role == "option") | ((role == "value") & F.col("_there")) | ((role == "emptied") & wins), F.lit(False))
    emptied = ruled & (F.when(role == "emptied", True).otherwise(~wins))
    value = F.when(emptied, "").when(role == "option", "yes").when(noise, "").otherwise(_v())
    drop = F.when(emptied, F.array(F.lit("missing_value"), F.lit("field_family_conflict"))).when(role == "option", F.array(F.lit("expected_empty"), F.lit("missing_value"))).otherwise(F.array(F.lit("expected_empty")))
    add = F.when(emptied, F.array(F.lit("expected_empty"))).when(conflict & ((role == "option") | ~noise), F.array(F.lit("field_family_conflict"))).otherwise(_none())
    pair = F.least(F.when(F.col("_mine") > 0, F.col("_mine")), F.when(own > 0, own))
    low = F.when(role == "option", F.col("_low")).when((role == "value") & wins & conflict & ~noise, F.col("_low")).when(role == "emptied", F.least(F.when(F.col("_best.c") > 0, F.col("_best.c")), F.when(own > 0, own))).otherwise(pair)
    out = rows.withColumns({
        "value": F.when(ruled, value).otherwise(_v()), "confidence": F.when(ruled, F.coalesce(low, own)).otherwise(own), "source_kind": F.when(ruled, "rule_family").otherwise(F.col("source_kind")),
        "review_reasons": F.when(ruled, F.array_union(F.array_except("review_reasons", drop), add)).otherwise(F.col("review_reasons")),
    })
    return out.drop("_code", "_family", "_all", "_options", "_place", "_n", "_best", "_low", "_mine", "_there")


def _petition_fields(rows: DataFrame, cut) -> DataFrame:
    digits = F.regexp_replace(_v(), "(?U)[^0-9]", "")
    rows = update(rows, digits, _petition_key().isin("ogrenci no", "tc kimlik no") & (F.length(digits) >= 4))
    rows = update(rows, F.regexp_extract(_v(), r"\b([0-9]+)\b", 1), _petition_key().isin("tamamlanan kredi", "ders kredisi", "akts", "ders notu") & _v().rlike(r"\b[0-9]+\b"))
    grade = F.regexp_extract(F.replace(_v(), F.lit(","), F.lit(".")), r"\b([0-9](?:\.[0-9]{1,2})?)\b", 1)
    rows = update(rows, grade, (_petition_key() == "gano") & (grade != ""))
    for key, labels in PETITION_LABELS.items():
        clean = _strip(text.strip_label(_v(), labels), " :/-")
        if key == "ders adi":
            clean = text.squeeze(F.replace(F.when(clean == "", _v()).otherwise(clean), F.lit("```"), F.lit(" ")))
            clean = F.trim(F.element_at(F.split(clean, ":"), -1))
            clean = F.trim(F.regexp_replace(clean, r"(?i)^(?:json|du)\b[:\s-]*", ""))
            clean = F.regexp_replace(clean, r"(?i)^[A-ZÇĞİÖŞÜ]{2,5}\s*[0-9]{2,4}[A-Z]?\s+", "")
            clean = _strip(F.regexp_replace(clean, r"(?i)\s+(?:akts|ects|dersin\s+kredisi|course\s+credit|kredi|ak)\b.*$", ""), " :/-")
        rows = update(rows, clean, (_petition_key() == key) & (clean != ""))
        if key == "danisman gorusu":
            rows = cut(rows)
    rows = cut(rows)
    years = F.translate(F.regexp_replace(F.regexp_extract(_v(), r"\b((?:19|20)[0-9]{2}\s*[-/.]\s*(?:19|20)[0-9]{2})\b", 1), r"\s+", ""), "./", "--")
    rows = update(rows, years, (_petition_key() == "egitim yili") & (years != ""))
    plain = text.normalize_text(_v())
    term = F.when(plain.contains("guz"), "Güz").when(plain.contains("bahar"), "Bahar").when(plain.contains("yaz"), "Yaz")
    rows = update(rows, term, (_petition_key() == "yariyil") & term.isNotNull())
    words = F.split(text.squeeze(_v()), " ")
    surname = cell("ad soyad", F.when(F.size(words) >= 2, F.lower(F.element_at(words, -1))))
    rows = rows.withColumn("_n", surname)
    typed = _v().rlike(r"\.\s*$") | (F.size(words) > 4) | (F.lower(text.squeeze(_v())) == F.coalesce("_n", F.lit("")))
    return update(rows, F.lit(""), (_petition_key() == "ogrenci imzasi") & (text.squeeze(_v()) != "") & typed, kind="expected_empty").drop("_n")


def repair(values: DataFrame, profile: str | None = None) -> DataFrame:
    """``values`` after all repairs, in their fixed order; rules for student petitions apply under that profile, or where three of its keys are there.

    Each rule reads what the last one left, so the plan is deep; it is cut by written tables of these narrow rows.
    """
    last: list[DataFrame] = []

    def cut(rows: DataFrame) -> DataFrame:
        """``rows`` written; nothing reads the table before them any longer."""
        last.append(written(rows, "repair"))
        if len(last) > 1:
            discard(last.pop(0))
        return last[0]

    columns = values.columns
    rows = values.withColumns({"value": F.coalesce("value", F.lit("")), "nk": text.normalize_text(F.col("source_key")), "review_reasons": F.coalesce("review_reasons", _none())})
    if profile is None:
        rows = rows.withColumn("_petition", F.size(F.collect_set(F.when(_key().isin(*PETITION_KEYS), _key())).over(_doc())) >= 3)
    else:
        rows = rows.withColumn("_petition", F.lit(profile == "student_petition_tr"))
    rows = _petition_contacts(rows)
    rows = cut(_bleed(cut(_contacts(_codes(cut(rows))))))
    rows = update(rows, F.regexp_replace(_v(), r"(?i)(?<=@)sampleemail\.com\b", "samplemail.com"), _v().contains("@") | has("contact info", "email"))
    rows = update(rows, F.trim(F.regexp_replace(_v(), r"(?iU)\s+(?:yes\s+no|no\s+yes)\s*$", "")), has("contact info", "witnesses", "describe") & _v().rlike(r"(?iU)\s(?:yes\s+no|no\s+yes)\s*$"), ("ocr_confusion_risk",))
    rows = _witnesses(cut(rows))
    rows = update(rows, text.strip_role(_v()), has("name"), ("ocr_confusion_risk",))
    rows = cut(_stations(cut(rows)))
    rows = update(rows, text.canonical_year(_v()), (_key() == "year") & (text.canonical_year(_v()) != ""), ("ocr_confusion_risk",))
    codes = similarity.repair_statutes(_v())
    rows = update(rows, codes, (_key() == "statutes") & (codes != ""), ("ocr_confusion_risk",))
    rows = cut(_families(cut(_dates(cut(rows)))))
    rows = cut(_report_year(rows))
    rows = _petition_fields(rows, cut)
    lines = F.array_join(F.filter(F.transform(F.split(_v(), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")
    return rows.withColumn("value", lines).select(*columns)
