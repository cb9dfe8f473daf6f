"""Fields found on a page by what is printed there: headings, labels, and the rules and boxes near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text

BAND = 64
#: Labels whose answers go on over the rules below.
LONG_ANSWERS = ("describe", "contact info")
#: Fixed value: the least similarity of a phrase on the page to a label that is looked for.
CLOSE_PHRASE = 0.72


def _bands(top: Column, bottom: Column) -> Column:
    return F.explode(F.sequence(F.floor(top / BAND), F.greatest(F.floor(top / BAND), F.floor(bottom / BAND))))


def heading_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """``boxes`` (doc_id, page_number, box_id, left, top, right, bottom) around a heading: a line in capitals, without a colon or a question mark.

    A line enters its own band of the page and a box every band that it crosses, so only neighbours are compared.
    """
    plain = F.trim("text")
    heads = lines.where((plain != "") & (plain == F.upper(plain)) & ~plain.rlike("[:?]"))
    heads = heads.select("doc_id", "page_number", F.floor(F.col("top") / BAND).alias("band"), *[F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")])
    wide = boxes.withColumn("band", _bands(F.col("top") - 6, F.col("bottom") + 6))
    inside = (F.col("l_top") >= F.col("top") - 6) & (F.col("l_bottom") <= F.col("bottom") + 6) & (F.col("l_left") >= F.col("left") - 8) & (F.col("l_right") <= F.col("right") + 8)
    hit = wide.join(heads, ["doc_id", "page_number", "band"]).where(inside).select("doc_id", "box_id").distinct()
    return boxes.join(hit, ["doc_id", "box_id"], "left_semi")


def continuations(fields: DataFrame, rules: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, field_id, left, top, right, bottom: the box around the next two rules that a long answer goes on over.

    A rule counts if it spans the field, lies below it, at most 60 units, and no text after the field's own line (``ord``) is near it, up to the first line that begins below it.
    fields: doc_id, page_number, field_id, label, ord and edges; rules: doc_id, page_number, rule_id and edges; lines: doc_id, page_number, ord, text, ignorable, top, bottom.
    """
    long = F.lit(False)
    for word in LONG_ANSWERS:
        long = long | F.lower("label").contains(word)
    own = fields.where(long).select("doc_id", "page_number", "field_id", "ord", *[F.col(c).alias(f"f_{c}") for c in ("left", "top", "right", "bottom")])
    page = ["doc_id", "page_number"]
    below = rules.join(own, page).where(
        (F.col("left") <= F.col("f_left") + 10) & (F.col("right") >= F.col("f_right") - 10)
        & ((F.col("top") + F.col("bottom")) / 2 > (F.col("f_top") + F.col("f_bottom")) / 2 + 8) & (F.col("top") - F.col("f_bottom") <= 60)
    )
    after = lines.select(*page, F.col("ord").alias("l_ord"), ((F.trim("text") != "") & ~F.col("ignorable")).alias("l_full"), F.col("top").alias("l_top"), F.col("bottom").alias("l_bottom"))
    b, w = below.alias("b"), after.alias("w")
    seen = b.join(w, [*[F.col(f"b.{c}") == F.col(f"w.{c}") for c in page], F.col("w.l_ord") > F.col("b.ord"), F.col("w.l_bottom") >= F.col("b.top") - 6], "left")
    past = F.col("l_top") > F.col("bottom") + 6
    seen = seen.groupBy("b.doc_id", "b.field_id", *[f"b.{c}" for c in ("top", "rule_id", "left", "right", "bottom")]).agg(F.min(F.when(past, F.col("l_ord"))).alias("stop"), F.min(F.when(~past & F.col("l_full"), F.col("l_ord"))).alias("near"))
    free = seen.where("near is null or stop < near")
    first = free.select("doc_id", "field_id", F.struct("top", "rule_id", "left", "right", "bottom").alias("r")).groupBy("doc_id", "field_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, 2).alias("rs"))
    side = lambda c, pick: pick(F.transform("rs", lambda r: r[c])).alias(c)
    return first.select("doc_id", "field_id", side("left", F.array_min), side("top", F.array_min), side("right", F.array_max), side("bottom", F.array_max))


def anchor_phrases(words: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """doc_id, page_number, spec, left, top, right, bottom, score: where each label that is looked for stands on a page.

    Of all phrases with as many words as a term, the one most like it counts, if it is like enough; ties go to the first term, then the first place.
    words: doc_id, page_number, ord, word and edges; ``terms``: (spec, term), a short list in order. A page's words are one group.
    """
    page = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ord", "word", "left", "top", "right", "bottom"))).alias("ws"))
    listed = F.array(*[F.struct(F.lit(spec).alias("spec"), F.lit(k).alias("rank"), F.lit(term).alias("term")) for k, (spec, term) in enumerate(terms)])
    asked = page.select("*", F.inline(listed)).withColumn("term", text.normalize_text(F.col("term"))).withColumn("n", F.size(F.split("term", " ")))
    places = asked.where((F.col("term") != "") & (F.size("ws") >= F.col("n")))
    chunks = places.select("doc_id", "page_number", "spec", "rank", "term", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.slice("ws", i, F.col("n")))).alias("at", "c"))
    phrase = F.array_join(F.transform("c", lambda w: w["word"]), " ")
    # matching blocks are no longer than the shorter text, so most phrases need no score
    chunks = chunks.withColumn("plain", text.normalize_text(phrase)).where(2 * F.least(F.length("plain"), F.length("term")) >= CLOSE_PHRASE * (F.length("plain") + F.length("term")))
    scored = chunks.withColumn("score", similarity.text_similarity(F.col("plain"), F.col("term"))).where(F.col("score") >= CLOSE_PHRASE)
    box = F.struct(F.get("c", F.lit(0))["left"].alias("left"), F.get("c", F.lit(0))["top"].alias("top"), F.element_at("c", -1)["right"].alias("right"), F.array_max(F.transform("c", lambda w: w["bottom"])).alias("bottom"))
    best = scored.groupBy("doc_id", "page_number", "spec").agg(F.max_by(F.struct(box.alias("box"), "score"), F.struct("score", -F.col("rank"), -F.col("at"))).alias("b"))
    return best.select("doc_id", "page_number", "spec", "b.box.*", "b.score")


def anchored_boxes(anchors: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, spec, page_number, left, top, right, bottom: for each anchor the rule nearest to it in the direction of its strategy, or a box of its own size beside it.

    anchors: doc_id, page_number, spec, strategy (underline_right, underline_below, underline_above), min_width, height and edges; candidates: doc_id, page_number, rule_id and edges;
    pages: doc_id, page_number, width, height. A box of its own of less than 40 units is left out.
    """
    c = candidates.select("doc_id", "page_number", "rule_id", *[F.col(x).alias(f"c_{x}") for x in ("left", "top", "right", "bottom")])
    a = anchors.join(pages.select("doc_id", "page_number", F.col("width").alias("p_width"), F.col("height").alias("p_height")), ["doc_id", "page_number"])
    key = ["doc_id", "page_number", "spec"]
    way = F.col("strategy")
    fits = (
        F.when(way == "underline_right", (F.col("c_bottom") >= F.col("top") - 8) & (F.col("c_top") <= F.col("bottom") + 18) & (F.col("c_left") >= F.col("right") - 10))
        .when(way == "underline_below", (F.col("c_top") >= F.col("bottom") - 6) & (F.col("c_top") <= F.col("bottom") + 38) & (F.col("c_right") >= F.col("left") + 40))
        .when(way == "underline_above", (F.col("c_bottom") >= F.col("top") - 28) & (F.col("c_top") <= F.col("bottom") + 10) & (F.col("c_left") >= F.col("left") - 10))
        .otherwise(True)
    )
    near = a.join(c, ["doc_id", "page_number"]).where(fits & (F.col("c_right") - F.col("c_left") >= F.col("min_width")))
    order = F.struct(F.abs(F.col("c_top") - F.col("bottom")), F.abs(F.col("c_left") - F.col("right")), F.col("rule_id"))
    best = near.groupBy(*key).agg(F.min_by(F.struct("c_left", "c_top", "c_right"), order).alias("c"))
    rows = a.join(best, key, "left")
    top = F.greatest(F.lit(0.0), F.col("c.c_top") + 1)
    found = F.struct(F.col("c.c_left").alias("left"), top.alias("top"), F.col("c.c_right").alias("right"), F.least(F.col("p_height") - 1, top + F.col("height")).alias("bottom"))
    left = F.when(way == "underline_below", F.col("left")).when(way == "underline_above", F.col("right") + 8).otherwise(F.col("right") + 10)
    high = F.when(way == "underline_below", F.col("bottom") + 8).when(way == "underline_above", F.col("top") - 4).otherwise(F.col("top") - 2)
    own = F.struct(left.alias("left"), F.greatest(F.lit(0.0), high).alias("top"), F.least(F.col("p_width") - 24, left + F.col("min_width")).alias("right"), F.least(F.col("p_height") - 24, high + F.col("height")).alias("bottom"))
    picked = F.when(F.col("c").isNotNull(), found).when(own["right"] - own["left"] >= 40, own)
    return rows.select(*key, picked.alias("b")).where("b is not null").select("doc_id", "spec", "page_number", "b.*")
