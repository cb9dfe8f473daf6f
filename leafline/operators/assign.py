"""Greedy one-to-one assignment within a document."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, similarity

_FOUND = T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("score", T.DoubleType())]))


def greedy(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc, source, target, score: sources in order each take their best free target; ties go to the first.

    scores: doc_id, source, source_ord, target, target_ord, score. Only scores above 0 count. A document's
    sources times targets are one group, which a page of fields bounds.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.score > 0].sort_values(["source_ord", "score", "target_ord"], ascending=[True, False, True])
        taken, out = set(), []
        for (_, source), rows in pdf.groupby(["source_ord", "source"], sort=False):
            free = rows[~rows.target.isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best.target)
                out.append((best[id_col], source, best.target, float(best.score)))
        return pd.DataFrame(out, columns=[id_col, "source", "target", "score"])

    kind = dict(scores.dtypes)[id_col]
    return scores.groupBy(id_col).applyInPandas(one, f"{id_col} {kind}, source string, target string, score double")


def _taken(values: list, targets: list, best) -> list[tuple[str, float] | None]:
    """What each value takes: in order, the target that ``best`` gives with its score. Both are in order; a value without a place or a name takes none.

    best: of the place of a value and the names that are taken, (score, place of the target), or None. Values of one place come by their best score.
    """
    taken: set = set()
    out: list[tuple[str, float] | None] = [None] * len(values)
    for place, run in itertools.groupby(range(len(values)), lambda i: values[i]["ord"]):
        named: dict[str, list[int]] = {}
        for i in run:
            if place is not None and values[i]["source"] is not None:
                named.setdefault(values[i]["source"], []).append(i)
        same = list(named.values())
        if len(same) > 1:
            alone = {s[0]: best(s[0], set()) or (0.0, len(targets)) for s in same}
            same.sort(key=lambda s: (-alone[s[0]][0], alone[s[0]][1]))
        for s in same:
            if (found := best(s[0], taken)) is not None:
                name = targets[found[1]]["target"]
                taken.add(name)
                for i in s:
                    out[i] = (name, found[0])
    return out


def _best_name(values: list, targets: list):
    """``best`` of ``_taken`` by the similarity of names. Letters in common bound a score, so few pairs are compared in full."""
    sides = list({(tuple(v[x] for v in values), tuple(t[y] for t in targets)) for x, ys in (("plain", ("label", "name")), ("own", ("own_label", "own_name"))) for y in ys})
    counted = [(xs, ys, [None if x is None else similarity.letters(x) for x in xs], np.array([similarity.letters(y or "") for y in ys]), np.array([-1 if y is None else len(y) for y in ys])) for xs, ys in sides]

    def best(i: int, taken: set) -> tuple[float, int] | None:
        bound = np.zeros(len(targets))
        for xs, _, letters, others, sizes in counted:
            if xs[i] is not None:
                bound = np.maximum(bound, np.where(sizes < 0, 0.0, similarity.most(letters[i], others, len(xs[i]), sizes)))
        top, pick = 0.0, len(targets)
        for j in np.argsort(-bound, kind="stable").tolist():
            if bound[j] <= 0 or bound[j] < top:
                break
            if targets[j]["target"] in taken or (bound[j] == top and j > pick):
                continue
            score = max(similarity.ratio(xs[i], ys[j]) for xs, ys, *_ in counted if xs[i] is not None and ys[j] is not None)
            if score > top or (score == top > 0 and j < pick):
                top, pick = score, j
        return (top, pick) if top > 0 else None

    return best


def _each(values: pd.Series, targets: pd.Series, best) -> pd.Series:
    """The array of ``_taken`` of each document."""
    lists = ((list(v), [] if t is None else list(t)) for v, t in zip(values, targets, strict=True))
    return pd.Series([[None if f is None else {"target": f[0], "score": f[1]} for f in _taken(v, t, best(v, t))] if t else [None] * len(v) for v, t in lists], dtype=object)


@F.pandas_udf(_FOUND)
def _names_taken(values: pd.Series, targets: pd.Series) -> pd.Series:
    return _each(values, targets, _best_name)


_SIDES = ("left", "top", "right", "bottom")


def _best_box(values: list, targets: list):
    """``best`` of ``_taken`` by overlap and distance, as ``geometry`` has them: a box against all targets at once."""
    pages = np.array([np.nan if t["page_number"] is None else t["page_number"] for t in targets], dtype=float)
    left, top, right, bottom = (np.array([t[c] for t in targets], dtype=float) for c in _SIDES)
    areas, names = np.maximum(right - left, 0) * np.maximum(bottom - top, 0), [t["target"] for t in targets]

    def best(i: int, taken: set) -> tuple[float, int] | None:
        a = values[i]
        if any(a[c] is None for c in ("page_number", *_SIDES)):
            return None
        w, h = max(a["right"] - a["left"], 0.0), max(a["bottom"] - a["top"], 0.0)
        x, y = np.minimum(a["right"], right) - np.maximum(a["left"], left), np.minimum(a["bottom"], bottom) - np.maximum(a["top"], top)
        common = np.where((pages == a["page_number"]) & (x > 0) & (y > 0), x * y, 0.0)
        union = w * h + areas - common
        iou = np.where(union == 0, 0.0, common / np.where(union == 0, 1.0, union))
        apart = np.hypot((a["left"] + a["right"] - left - right) / 2, (a["top"] + a["bottom"] - top - bottom) / 2) / max(np.hypot(w, h), 1.0)
        score = iou * 0.7 + (1 - np.where(pages == a["page_number"], np.minimum(apart, 1.0), 1.0)) * 0.3
        score = np.nan_to_num(np.where([n in taken for n in names], 0.0, score))
        j = int(score.argmax())
        return (float(score[j]), j) if score[j] > 0 else None

    return best


@F.pandas_udf(_FOUND)
def _boxes_taken(values: pd.Series, targets: pd.Series) -> pd.Series:
    return _each(values, targets, _best_box)


def _listed(values: DataFrame, targets: DataFrame, v: str, t: str, taken) -> DataFrame:
    """doc_id, source, confidence, target, score of each value: what ``taken`` gives for the lists of a document."""
    one = lambda df, c: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(c)).alias(c))
    found = one(values, v).join(one(targets, t), "doc_id", "left").withColumn("found", taken(v, t))
    return found.select("doc_id", F.inline(F.arrays_zip(F.col(v).alias("v"), "found"))).select("doc_id", "v.source", "v.confidence", "found.target", "found.score")


def map_values(values: DataFrame, targets: DataFrame, aliases: Column | None = None, least: float = 0.6) -> DataFrame:
    """Values (doc_id, ord, source_key, confidence) mapped to targets (doc_id, ord, name, label) by the similarity of names.

    A status of mapped needs a mean of score and confidence of ``least``. ``aliases`` is a map from normalised names to canonical keys.
    A row a value. A document's values and targets are one group, which a page of fields bounds; a pair is no row of its own.
    """
    from ..functions.text import normalize_text

    def canon(c: Column) -> Column:
        plain = normalize_text(c)
        bare = F.replace(plain, F.lit(" "), F.lit("_"))
        return F.coalesce(F.try_element_at(aliases, plain), bare) if aliases is not None else bare

    # texts that are compared, null for those that have nothing to compare
    said = lambda c: F.when(F.coalesce(c, F.lit("")) != "", normalize_text(c))
    label = F.coalesce(F.nullif("label", F.lit("")), "name")
    v = values.select("doc_id", F.struct("ord", F.col("source_key").alias("source"), "confidence", said(F.col("source_key")).alias("plain"), said(canon(F.col("source_key"))).alias("own")).alias("v"))
    t = targets.select("doc_id", F.struct("ord", F.col("name").alias("target"), said(label).alias("label"), said(F.col("name")).alias("name"), said(canon(label)).alias("own_label"), said(canon(F.col("name"))).alias("own_name")).alias("t"))
    out = _listed(v, t, "v", "t", _names_taken)
    mean = (F.least("score", F.lit(1.0)) + F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))) / 2
    return out.select("doc_id", F.col("source").alias("source_key"), F.coalesce("target", F.lit("")).alias("target_field"), F.when(F.col("target").isNull(), 0.0).otherwise(F.coalesce(mean, F.lit(0.0))).alias("confidence"), F.when(F.col("target").isNull(), "unmapped").when(mean >= least, "mapped").otherwise("needs_review").alias("status"))


def map_boxes(detected: DataFrame, fields: DataFrame) -> DataFrame:
    """Detected fields (doc_id, ord, label, confidence, box) mapped to named ones (doc_id, ord, name, box) by overlap and distance."""
    edges = lambda: [F.col(f"box.{c}").cast(k).alias(c) for c, k in (("page_number", "long"), ("left", "double"), ("top", "double"), ("right", "double"), ("bottom", "double"))]
    d = detected.select("doc_id", F.struct("ord", F.col("label").alias("source"), "confidence", *edges()).alias("d"))
    t = fields.where("box is not null").select("doc_id", F.struct("ord", F.col("name").alias("target"), *edges()).alias("t"))
    out = _listed(d, t, "d", "t", _boxes_taken)
    return out.select("doc_id", F.col("source").alias("source_key"), F.coalesce("target", F.lit("")).alias("target_field"), F.coalesce((F.col("score") + F.col("confidence")) / 2, F.lit(0.0)).alias("confidence"), F.when(F.col("target").isNull(), "unmapped").when(F.col("score") >= 0.35, "mapped").otherwise("needs_review").alias("status"))


def filled_values(values: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, target_field, value, confidence: mapped values; the later mapping of a target wins, whatever its status."""
    m = mappings.where("target_field <> ''").select("doc_id", "source_key", "target_field", F.col("confidence").alias("mapped"))
    joined = values.join(m, ["doc_id", "source_key"])
    w = Window.partitionBy("doc_id", "target_field").orderBy(F.desc("ord"))
    return joined.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "target_field", "value", ((F.col("confidence") + F.col("mapped")) / 2).alias("confidence"))
