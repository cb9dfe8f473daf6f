"""Duplicates by key, first or last; unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; one aggregate row a key and task reaches the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def last_value_first_place(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key with its last value, at the place where the key first came."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def rounded_box(box: str) -> list[Column]:
    """Half-even rounded edges, for geometry keys."""
    return [F.bround(f"{box}.{side}", 0).alias(f"r_{side}") for side in ("left", "top", "right", "bottom")]


def distinct_boxes(fields: DataFrame) -> DataFrame:
    """Fields (kind, box, ord, ...) with one of each kind, page and rounded box: the first."""
    sides = ["r_left", "r_top", "r_right", "r_bottom"]
    keyed = fields.select("*", F.col("box.page_number").alias("r_page"), *rounded_box("box"))
    return keep_first(keyed, ["kind", "r_page", *sides], ["ord"]).select(*fields.columns)


def _taken(names: Column, name: Column) -> Column:
    return F.array_contains(names, name)


def unique_slugs(labels: Column) -> Column:
    """Slugs of an array of labels in order; a slug that is taken gets the first free suffix from _2 on.

    A fold over the array, so that a label that spells a suffix of another's is seen; ``unique_names`` is the way for long lists.
    """

    def step(names: Column, label: Column) -> Column:
        slug = text.slugify(label)
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(names) + 2), lambda k: F.concat(slug, F.lit("_"), k.cast("string"))), lambda c: ~_taken(names, c))
        return F.concat(names, F.array(F.when(_taken(names, slug), F.get(free, F.lit(0))).otherwise(slug)))

    return F.aggregate(labels, F.array().cast("array<string>"), step)


def unique_names(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """``keys``, ``order`` and name of each row: the slug of its label, with the first free suffix from _2 on if an earlier row of the key has it.

    Only slugs that differ by numbers at their ends can take each other's names. A family of such with one slug is numbered by a window;
    one with several, which few labels are, is folded in order. ``order`` tells the rows of a key apart; a null label is a blank one.
    """
    slug = text.slugify(F.col(label))
    named = rows.select(*keys, order, F.col(label).alias("_label"), slug.alias("_slug"), F.regexp_replace(slug, "(_[0-9]+)+$", "").alias("_root"))
    family = [*keys, "_root"]
    mixed = named.groupBy(*family).agg(F.min("_slug").alias("lo"), F.max("_slug").alias("hi")).where("lo <> hi").select(*family)
    same = lambda how: named.alias("n").join(mixed.alias("m"), [F.col(f"n.{c}").eqNullSafe(F.col(f"m.{c}")) for c in family], how)
    place = F.row_number().over(Window.partitionBy(*keys, "_slug").orderBy(order))
    plain = same("left_anti").select(*keys, order, F.when(place == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("_"), place.cast("string"))).alias("name"))
    lists = same("left_semi").groupBy(*family).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_label").alias("l")))).alias("rows"))
    folded = lists.select(*keys, F.explode(F.arrays_zip(F.col("rows.o").alias("o"), unique_slugs(F.transform("rows", lambda r: r["l"])).alias("name"))).alias("z"))
    return plain.unionByName(folded.select(*keys, F.col("z.o").alias(order), F.col("z.name").alias("name")))
