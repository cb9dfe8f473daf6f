"""Canonical forms of noisy text, as column expressions."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded before accents are removed.
FOLD_FROM, FOLD_TO = "ıİğĞşŞçÇöÖüÜ", "iIgGsScCoOuU"
#: Misread address words.
ADDRESS_FIXES = {"illiwas": "illinois", "peit": "pe17"}
#: Words that don't tell stations apart.
STATION_NOISE = ["police", "station", "ps", "form", "no", "w", "b", "p", "s", "year", "at"]
#: What a checkbox may read.
CHECKED = ["yes", "true", "on", "checked", "1", "selected"]
UNCHECKED = ["no", "false", "off", "unchecked", "0", "unselected"]
#: Fixed value: a role after a person's name, to the end.
ROLE_TAIL = r"(?iU)(?:,\s*|\s+)(?:s\.?\s*i\.?|si|sub[- ]?inspector|inspector|constable|officer|informant|of police|police)\b.*$"
#: Fixed value: names that say nothing about a field.
GENERIC_NAME = r"(?i)^(field|text|textbox|checkbox|radio|button|choice|signature|untitled|page)[_\-\s]*\d*$"

PHONE = r"(\+?\d[\d()\-\s]{6,}\d)"
EMAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """(from, to) of characters with one ASCII letter in NFKD, and those with more."""
    single, several = {}, {}
    for code in range(128, 0x10000):
        c = chr(code)
        if c in FOLD_FROM or unicodedata.category(c) == "Cs":
            continue
        ascii_ = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)
        if len(ascii_) == 1:
            single[c] = ascii_
        elif ascii_:
            several[c] = ascii_
    return "".join(single), "".join(single.values()), several


def _ranges(chars: list[str]) -> str:
    """A character class of ``chars``, neighbours merged into ranges."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def normalize_text(text: Column) -> Column:
    """Lower-case ASCII words with one space between: accents folded, other characters dropped, letters and digits parted; null is empty.

    Only texts with other than ASCII characters are folded, and only those with a character that stands for several letters are spelled out.
    """
    one, to, several = _decompositions()
    plain = F.coalesce(text, F.lit(""))
    folded = F.translate(plain, FOLD_FROM + one, FOLD_TO + to)
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded into one literal
    letters = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")
    folded = F.when(folded.rlike(_ranges(list(several))), letters).otherwise(folded)
    ascii_ = F.when(plain.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]+", "")).otherwise(plain)
    parted = F.regexp_replace(F.lower(ascii_), "([0-9]+)", " $1 ")
    return F.trim(F.regexp_replace(parted, "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def slugify(text: Column, fallback: str = "field") -> Column:
    return F.coalesce(F.nullif(F.replace(normalize_text(text), F.lit(" "), F.lit("_")), F.lit("")), F.lit(fallback))


def is_semantic_name(name: Column) -> Column:
    return (name != "") & (slugify(name) == name) & ~name.rlike(GENERIC_NAME)


def drop_repeats(tokens: Column) -> Column:
    """Without tokens that equal the one before."""
    return F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))


def _words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def canonical_address(normalized: Column) -> Column:
    fixes = F.create_map(*[F.lit(x) for pair in ADDRESS_FIXES.items() for x in pair])
    return F.array_join(F.transform(_words(normalized), lambda t: F.coalesce(F.try_element_at(fixes, t), t)), " ")


def canonical_station(normalized: Column) -> Column:
    kept = F.filter(_words(normalized), lambda t: ~t.isin(STATION_NOISE) & ~t.rlike("^[0-9]+$"))
    return F.array_join(drop_repeats(kept), " ")


def strip_role(value: Column) -> Column:
    """A person's name without a role after it."""
    return F.regexp_replace(F.regexp_replace(squeeze(value), ROLE_TAIL, ""), r"^[ ,.\-]+|[ ,.\-]+$", "")


def canonical_name(value: Column) -> Column:
    """Name words: initials joined to a longer word after them, a doubled name once, no repeats."""

    def join(state: Column, word: Column) -> Column:
        glue = (F.length(state["wait"]) > 0) & (F.length(word) >= 4)
        done = F.when(glue, F.concat(state["out"], F.array(F.concat(state["wait"], word)))).when(F.length(state["wait"]) > 0, F.concat(state["out"], F.array(state["wait"]))).otherwise(state["out"])
        short = ~glue & (F.length(word) <= 2)
        return F.struct(F.when(short | glue, done).otherwise(F.concat(done, F.array(word))).alias("out"), F.when(short, word).otherwise(F.lit("")).alias("wait"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("wait"))
    words = F.aggregate(_words(normalize_text(strip_role(value))), start, join, lambda s: F.when(s["wait"] != "", F.concat(s["out"], F.array(s["wait"]))).otherwise(s["out"]))
    n = F.size(words)
    half = (n / 2).cast("int")
    twice = (n >= 4) & (n % 2 == 0) & (F.slice(words, 1, F.greatest(half, F.lit(1))) == F.slice(words, half + 1, F.greatest(half, F.lit(1))))
    return F.array_join(drop_repeats(F.when(twice, F.slice(words, 1, F.greatest(half, F.lit(1)))).otherwise(words)), " ")


def pivot_year(two_digits: Column) -> Column:
    n = F.try_to_number(two_digits, F.lit("99")).cast("int")
    return F.when(n < 40, n + 2000).otherwise(n + 1900).cast("string")


def canonical_year(value: Column) -> Column:
    text = squeeze(value)
    tail = F.regexp_extract(text, r"[./-]([0-9]{2})\s*$", 1)
    four = F.try_element_at(F.regexp_extract_all(text, F.lit("((?:19|20)[0-9]{2})"), F.lit(1)), F.lit(-1))
    two = F.try_element_at(F.regexp_extract_all(text, F.lit("(?<![0-9])([0-9]{2})(?![0-9])"), F.lit(1)), F.lit(-1))
    digits = F.regexp_replace(text, "[^0-9]", "")
    last = F.right(digits, F.lit(4))
    return (
        F.when(text == "", "")
        .when(tail != "", pivot_year(tail))
        .when(four.isNotNull(), four)
        .when(two.isNotNull(), pivot_year(two))
        .when((F.length(digits) >= 4) & last.rlike("^(19|20)"), last)
        .otherwise(normalize_text(text))
    )


def checkbox_state(plain: Column) -> Column:
    """true, false or the normalised text itself."""
    return F.when(plain.isin(CHECKED), "true").when(plain.isin(UNCHECKED), "false").otherwise(plain)


def canonical_value(value: Column, plain: Column, name: Column) -> Column:
    """The form in which a field's values are compared; its key chooses the rule.

    ``plain`` and ``name`` are the normalised value and key, best as columns of their own, which
    are then computed once. Statutes are repaired before (``similarity.repair_statutes``).
    """
    station = name.contains("police station") | name.endswith("station")
    return (
        F.when(plain == "", plain)
        .when(name.contains("name"), canonical_name(value))
        .when(name == "year", canonical_year(value))
        .when(station & name.contains("address"), canonical_station(canonical_address(plain)))
        .when(name.contains("address"), canonical_address(plain))
        .when(station, canonical_station(plain))
        .otherwise(plain)
    )


def logical_name(name: Column) -> Column:
    """The field that a continuation (name__body or name__body_k) belongs to."""
    base = F.regexp_extract(name, r"^(.+)__body(?:_([0-9]+))?$", 1)
    return F.when(base != "", base).otherwise(name)


def continuation_index(name: Column) -> Column:
    base = F.regexp_extract(name, r"^(.+)__body(?:_([0-9]+))?$", 1)
    index = F.regexp_extract(name, r"^(.+)__body(?:_([0-9]+))?$", 2)
    return F.when(base == "", 0).when(index == "", 1).otherwise(F.expr("0") + index.try_cast("int"))


def strip_label(value: Column, labels: tuple[str, ...]) -> Column:
    """``value`` without one of ``labels`` and its separator in front."""
    out = F.trim(value)
    for label in labels:
        out = F.regexp_replace(out, rf"(?i)^\s*{re.escape(label)}\s*(?:[:.\-]\s*|\s+)", "")
    plain = sorted({" ".join(re.findall("[a-z]+|[0-9]+", x.lower())) for x in labels})
    # the first separator with a label in front of it; one lambda, so the text is not spelled out for each separator
    cut = lambda s: F.struct(F.call_function("substring_index", out, s, F.lit(1)).alias("p"), (F.instr(out, s) > 0).alias("has"), F.trim(F.substring(out, F.instr(out, s) + F.length(s), F.length(out))).alias("rest"))
    cuts = F.transform(F.array(*[F.lit(x) for x in (":", "-", ".", " - ", " / ")]), cut)
    mine = F.filter(cuts, lambda c: c["has"] & normalize_text(c["p"]).isin(plain))
    return F.coalesce(F.get(mine, F.lit(0))["rest"], out)


def first_email(value: Column) -> Column:
    return F.regexp_extract(value, EMAIL, 1)


def first_phone(value: Column) -> Column:
    bare = strip_label(value, ("phone", "tel", "telephone", "mobile", "cell"))
    found = F.regexp_extract(bare, PHONE, 1)
    return F.when(found == "", bare).otherwise(F.trim(F.regexp_replace(found, r"\s+", " ")))


def short_date(value: Column) -> Column:
    """m/d/y or m.d.y as a date, two-digit years turning at 40; null if it is none."""
    text = squeeze(value)
    parts = F.split(text, F.when(text.contains("/"), "/").otherwise(r"\."))
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    year = F.when(number(2) < 100, number(2) + F.when(number(2) < 40, 2000).otherwise(1900)).otherwise(number(2))
    good = (F.size(parts) == 3) & number(0).between(1, 12) & number(1).between(1, 31)
    return F.when(good, F.try_to_date(F.format_string("%04d-%02d-%02d", year, number(0), number(1)), "yyyy-MM-dd"))


def report_year(value: Column) -> Column:
    return F.regexp_extract(squeeze(value), r"(?:,\s*|\s+)((?:19|20)[0-9]{2})\s*$", 1)


def without_report_year(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(squeeze(value), r"(?:,\s*|\s+)((?:19|20)[0-9]{2})\s*$", ""), r"[ ,]+$", "")


def year_field(value: Column) -> Column:
    return F.regexp_extract(squeeze(value), r"((?:19|20)[0-9]{2}|[0-9]{2})\s*$", 1)


def digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", ""))


def json_payload(text: Column) -> Column:
    """The outermost {...} of a reply, without code fences, as a variant; null if it is no JSON."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)^\s*```(?:json)?\s*", ""), r"```\s*$", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))
