"""Fields of a flat page, found from its text lines and the rules drawn on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import anchors, dedup, layout

#: What an answer to tick reads, the font of the marks before it, and texts that begin lines without fields.
YES_NO, HALVES = ("Yes", "No"), ("AM", "PM")
MARK_FONT = "Times New Roman"
NO_FIELDS = ("Page ", "Use this form", "incidents, or student", "24 hours of the event")
#: Fixed value: the label of a rule after a year that is printed in part.
YEAR_LABEL = "Report Year"
#: Confidence of labels with a rule, of lone ones, of lone years, of years after a label, and of marks.
LABELLED, LONE, LONE_YEAR, YEAR, MARKED = 0.80, 0.76, 0.72, 0.66, 0.78
#: Fixed values, in page units: the least width of an answer, of the rule of a year, and how far a context line may be above.
LEAST_ANSWER, LEAST_YEAR, CONTEXT = 22.0, 28.0, 35.0

_KEY = ["doc_id", "page_number"]
_FIELD = "struct<label:string,left:double,top:double,right:double,bottom:double,confidence:double>"


def _is_answer(plain: Column) -> Column:
    return plain.isin(*YES_NO, *HALVES)


def is_label(plain: Column) -> Column:
    return (plain != "") & ~_is_answer(plain) & (plain.endswith(":") | plain.endswith("?") | plain.contains("No.") | plain.contains("E-Mail"))


def looks_like_label(plain: Column) -> Column:
    return ~_is_answer(plain) & ~plain.startswith("Page ") & (F.length(plain) >= 3) & plain.rlike(r"\p{L}")


def is_heading(plain: Column) -> Column:
    return (plain == F.upper(plain)) & ~plain.contains(":") & ~plain.contains("?")


def names_year(plain: Column) -> Column:
    """A line that may be nothing but the start of a year."""
    return plain.contains("20") & plain.contains(",")


def clean_label(plain: Column) -> Column:
    return F.regexp_replace(plain, r"(?:\s*[:?.,])+$", "")


def page_lines(spans: DataFrame) -> DataFrame:
    """A row a line: doc_id, page_number, ord, text, edges, spans, marks (left edges of tick boxes), ignorable.

    spans: doc_id, page_number, line, ord, text, font and edges. A line is as large as its spans are together.
    """
    plain = text.squeeze(F.col("text"))
    one = F.struct("ord", plain.alias("plain"), F.coalesce("text", F.lit("")).alias("text"), ((plain == "") & F.coalesce(F.col("font").contains(MARK_FONT), F.lit(False))).alias("mark"), "left", "right")
    edges = [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")]
    lines = spans.groupBy(*_KEY, F.col("line").alias("ord")).agg(F.array_sort(F.collect_list(one)).alias("all"), *edges)
    whole = text.squeeze(F.array_join(F.transform("all", lambda s: s["text"]), ""))
    lines = lines.withColumn("text", whole).withColumn("marks", F.transform(F.filter("all", lambda s: s["mark"]), lambda s: s["left"]))
    lines = lines.withColumn("spans", F.transform(F.filter("all", lambda s: s["plain"] != ""), lambda s: F.struct(s["plain"].alias("plain"), s["left"].alias("left"), s["right"].alias("right")))).drop("all")
    line, begins = F.col("text"), F.lit(False)
    for start in NO_FIELDS:
        begins = begins | line.startswith(start)
    ticked = (F.size("marks") > 0) & line.isin(*HALVES)
    return lines.withColumn("ignorable", F.when(line == "", True).when(names_year(line) | ticked, False).otherwise(begins | is_heading(line)))


def answer_rules(drawings: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_number, rule_id (in order of top and left), edges: where answers are written, over underlines and in boxes without a heading.

    drawings: doc_id, page_number, ord and corners x0, y0, x1, y1.
    """
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    at = [*_KEY, "ord"]
    edges = lambda top, bottom: [F.col("x0").alias("left"), top.alias("top"), F.col("x1").alias("right"), bottom.alias("bottom")]
    under = drawings.where((wide >= 35) & (high <= 3.5)).select(*at, *edges(F.greatest(F.lit(0.0), F.col("y0") - 18), F.col("y0") + 4))
    boxes = drawings.where((wide >= 120) & high.between(12.0, 30.0)).select(*_KEY, F.col("ord").alias("box_id"), *edges(F.col("y0"), F.col("y1")))
    headed = anchors.heading_boxes(boxes, lines)
    free = boxes.join(headed.select(*_KEY, "box_id"), [*_KEY, "box_id"], "left_anti").withColumnRenamed("box_id", "ord")
    order = Window.partitionBy(*_KEY).orderBy("top", "left", "ord")
    return under.unionByName(free).withColumn("rule_id", F.row_number().over(order)).drop("ord")


def rules_on_lines(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``lines`` with ``rules``: those beside each line, in order; a line that names a year looks further to the right."""
    near = layout.candidates_on_lines(lines.select(*_KEY, "ord", "text", "left", "top", "right", "bottom"), rules)
    near = near.where(F.col("r_left") <= F.col("right") + F.when(F.col("text").contains(", 20"), 160.0).otherwise(80.0))
    one = F.struct("rule_id", F.col("r_left").alias("left"), F.col("r_top").alias("top"), F.col("r_right").alias("right"), F.col("r_bottom").alias("bottom"))
    return lines.join(near.groupBy(*_KEY, "ord").agg(F.array_sort(F.collect_list(one)).alias("rules")), [*_KEY, "ord"], "left")


def _answer(label: Column, rule: Column, left: Column, right: Column, confidence: float) -> Column:
    return F.struct(label.alias("label"), left.cast("double").alias("left"), rule["top"].alias("top"), right.cast("double").alias("right"), rule["bottom"].alias("bottom"), F.lit(confidence).alias("confidence")).cast(_FIELD)


def _taken_rules(labels: Column, rules: Column, controls: Column) -> Column:
    """struct used, found: each label in order takes the first rule that is free, to its right and before the next answer to tick."""
    state = lambda used, found: F.struct(used.cast("array<int>").alias("used"), found.cast(f"array<{_FIELD}>").alias("found"))
    none = state(F.array(), F.array())

    def step(st: Column, label: Column) -> Column:
        barrier = F.coalesce(F.array_min(F.filter(controls, lambda x: x > label["right"] + 6)), F.lit(float("inf")))
        free = F.filter(rules, lambda r: ~F.array_contains(st["used"], r["rule_id"]) & (r["right"] > label["right"] + 8) & (r["left"] < barrier))
        rule = F.get(free, F.lit(0))
        left, right = F.greatest(rule["left"], label["right"] + 4), F.least(rule["right"], barrier - 6)
        taken = state(F.array_append(st["used"], rule["rule_id"]), F.array_append(st["found"], _answer(clean_label(label["plain"]), rule, left, right, LABELLED)))
        return F.when(rule.isNotNull() & (right - left >= LEAST_ANSWER), taken).otherwise(st)

    return F.aggregate(labels, none, step)


def answers_of_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, place, label, edges, confidence, hint: the answers on rules that the labels of each line take.

    Labels are printed as such, or a lone text with a rule to its right is one. A lone label with a lone rule takes it in any case, and rules
    that are left after the only label of a line belong to the year that the line names. ``lines``: of ``rules_on_lines``.
    """
    rows = lines.where(~F.col("ignorable") & F.col("rules").isNotNull())
    rule, line = F.col("rules"), F.col("text")
    printed = F.filter("spans", lambda s: is_label(s["plain"]))
    lone = F.get("spans", F.lit(0))
    inferred = (F.size("marks") == 0) & (F.size("spans") == 1) & looks_like_label(lone["plain"]) & F.exists(rule, lambda r: r["left"] >= lone["right"] + 12)
    rows = rows.withColumn("labels", F.when((F.size(printed) > 0) | names_year(line), printed).when(inferred, F.col("spans")).otherwise(F.array().cast("array<struct<plain:string,left:double,right:double>>")))
    ticks = F.concat(F.transform(F.filter("spans", lambda s: _is_answer(s["plain"])), lambda s: s["left"]), "marks")
    rows = rows.withColumn("taken", F.explode(F.array(_taken_rules(F.col("labels"), rule, ticks))))
    found, used, only = F.col("taken.found"), F.col("taken.used"), F.get("labels", F.lit(0))
    first = F.get(rule, F.lit(0))
    start = F.greatest(first["left"], only["right"] + 4)
    fallback = (F.size(found) == 0) & (F.size(rule) == 1) & (F.size("labels") == 1) & (first["right"] - start >= LEAST_ANSWER)
    found = F.when(fallback, F.array(_answer(clean_label(only["plain"]), first, start, first["right"], LONE))).otherwise(found)
    named = F.exists(found, lambda f: f["label"] == YEAR_LABEL)
    open_ = F.filter(rule, lambda r: ~F.array_contains(used, r["rule_id"]) & (r["right"] - r["left"] >= LEAST_YEAR))
    years = F.transform(open_, lambda r, i: _answer(F.when((i == 0) & ~named, YEAR_LABEL).otherwise(f"{YEAR_LABEL} 2"), r, r["left"], r["right"], YEAR))
    both = F.when((F.size("labels") == 1) & line.contains(", 20"), F.concat(found, years)).otherwise(found)
    gap = lambda r: F.struct((r["right"] < F.col("right") + 6).cast("int").alias("behind"), F.abs(r["left"] - F.col("right")).alias("gap"), r["rule_id"].alias("id"), r.alias("r"))
    nearest = F.array_min(F.transform(rule, gap))["r"]
    year = F.array(_answer(F.lit(YEAR_LABEL), nearest, nearest["left"], nearest["right"], LONE_YEAR))
    fields = F.when((F.size("labels") == 0) & names_year(line), year).otherwise(both)
    return rows.select(*_KEY, "ord", F.col("text").alias("hint"), F.posexplode(fields).alias("place", "f")).select(*_KEY, "ord", "place", "f.*", "hint")


def with_context(lines: DataFrame, name: str, ending: str, most: float = CONTEXT) -> DataFrame:
    """``lines`` with ``name``: the text of the last line above that ends so, if neither it nor a line after it is more than ``most`` above this one; else empty.

    Two running windows: the lowest bottom since the last context line, and that line's text, both as of the line before.
    """
    page = Window.partitionBy(*_KEY).orderBy("ord")
    is_context = ~F.col("ignorable") & F.col("text").endswith(ending)
    rows = lines.withColumn("_part", F.count(F.when(is_context, 1)).over(page)).withColumn("_context", F.last(F.when(is_context, F.col("text")), ignorenulls=True).over(page))
    rows = rows.withColumn("_low", F.min("bottom").over(Window.partitionBy(*_KEY, "_part").orderBy("ord")))
    rows = rows.withColumn("_before", F.lag(F.struct("_context", "_low")).over(page))
    found = F.when(F.col("top") - F.col("_before._low") <= most, F.col("_before._context"))
    return rows.withColumn(name, F.coalesce(found, F.lit(""))).drop("_part", "_context", "_low", "_before")


def ticks_of_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, place, label, edges, confidence, hint: the tick boxes of each line, named by the option after them and what is asked.

    Yes and No belong to the question on the line or above it, AM and PM to the label; any other option stands for itself.
    """
    rows = with_context(with_context(lines, "asked", "?"), "labelled", ":").where(~F.col("ignorable") & (F.size("marks") > 0))
    own = lambda keep, at: F.try_element_at(F.transform(F.filter("spans", keep), lambda s: s["plain"]), F.lit(at))
    question = F.coalesce(own(lambda s: s["plain"].endswith("?"), 1), F.col("asked"))
    label = F.coalesce(own(lambda s: is_label(s["plain"]), -1), F.col("labelled"))
    rows = rows.select("*", question.alias("question"), label.alias("label_"), F.posexplode("marks").alias("place", "mark"))
    option = F.get(F.transform(F.filter("spans", lambda s: s["left"] > F.col("mark") + 1), lambda s: s["plain"]), F.lit(0))
    rows = rows.withColumn("option", option).where("option is not null")
    of = lambda c: F.concat(clean_label(F.col(c)), F.lit(" "), F.col("option"))
    name = F.when(F.col("option").isin(*YES_NO) & (F.col("question") != ""), of("question")).when(F.col("option").isin(*HALVES) & (F.col("label_") != ""), of("label_")).otherwise(F.concat(clean_label(F.col("option")), F.lit(" Selected")))
    edges = [F.greatest(F.lit(0.0), F.col("mark") - 10.5).alias("left"), (F.col("top") + 0.5).alias("top"), (F.col("mark") + 1.0).alias("right"), (F.col("top") + 11.5).alias("bottom")]
    return rows.select(*_KEY, "ord", "place", name.alias("label"), *edges, F.lit(MARKED).alias("confidence"), F.col("text").alias("hint"))


def detect_fields(spans: DataFrame, drawings: DataFrame) -> DataFrame:
    """doc_id, ord (in the document), page_number, label, kind, edges, confidence, hint, continuation: the fields of flat pages.

    Lines are read from spans, answers stand on rules and in boxes, tick boxes before their options; a long answer goes on over the next rules.
    Of fields with the same kind, label, page and rounded box the first in the order of lines stays. All steps are joins by page and band, windows
    and folds over one line, so no page is a task of its own. A page without lines or an empty table has no fields; null texts count as empty.
    """
    lines = page_lines(spans)
    rules = answer_rules(drawings, lines)
    answers = answers_of_lines(rules_on_lines(lines, rules)).withColumn("field_id", F.concat_ws("/", "page_number", "ord", "place"))
    more = anchors.continuations(answers.select(*_KEY, "field_id", "label", "ord", "left", "top", "right", "bottom"), rules, lines)
    answers = answers.join(more.select("doc_id", "field_id", F.struct("left", "top", "right", "bottom").alias("continuation")), ["doc_id", "field_id"], "left").drop("field_id")
    answers = answers.withColumn("kind", F.when(F.col("continuation").isNotNull(), "multiline").otherwise("text")).withColumn("branch", F.lit(0))
    ticks = ticks_of_lines(lines).withColumn("kind", F.lit("checkbox")).withColumn("branch", F.lit(1))
    every = answers.unionByName(ticks, allowMissingColumns=True)
    rounded = [F.bround(c, 0).alias(f"_{c}") for c in ("left", "top", "right", "bottom")]
    first = dedup.keep_first(every.select("*", *rounded), ["doc_id", "page_number", "kind", "label", "_left", "_top", "_right", "_bottom"], ["ord", "branch", "place"])
    order = Window.partitionBy("doc_id").orderBy("page_number", "_line", "branch", "place")
    first = first.withColumnRenamed("ord", "_line").withColumn("ord", F.row_number().over(order))
    return first.select("doc_id", "ord", "page_number", "label", "kind", "left", "top", "right", "bottom", "confidence", "hint", "continuation")
