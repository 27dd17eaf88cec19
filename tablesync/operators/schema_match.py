"""Schema matching: which tables and fields of two catalogs belong together.

Name similarity is difflib's ratio, which no built-in expression gives, so pairs of names are
scored in a pandas UDF. Which pairs: a ratio counts characters matched in order, so it is at
most the Dice coefficient of the two names' characters with repeats. An inverted index of these
characters, rarest first and cut where no ratio above the threshold can be missed, gives the
pairs; names held by other names come from an index of their n-grams. Each pair of distinct
names is scored once; weights, types, thresholds and the best of each row are expressions.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.catalog import type_score

TABLE_THRESHOLD = 0.5
FIELD_THRESHOLD = 0.7
CONTAINED_SCORE = 0.8
NAME_WEIGHT, TYPE_WEIGHT, LABEL_WEIGHT = 0.4, 0.3, 0.3
# A field scores above its threshold only if its name's ratio is above this, whatever the rest.
_FIELD_NAME = (FIELD_THRESHOLD - TYPE_WEIGHT - LABEL_WEIGHT) / NAME_WEIGHT
_GRAM = 3
_SLACK = 1e-9  # thresholds are met in doubles: the bounds give way by this much


def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


def table_similarity(left: str, right: str) -> float:
    left, right = (n.lower().replace("_", "") for n in (left, right))
    if left == right:
        return 1.0
    score = _ratio(left, right)
    return max(score, CONTAINED_SCORE) if left in right or right in left else score


@F.pandas_udf(T.DoubleType())
def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _table_scores(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([table_similarity(x, y) for x, y in zip(left, right)], dtype="float64")


def _marks(name: Column) -> Column:
    """The characters of a name, each with the number of its occurrence; an empty name has
    one mark, as two empty names are alike."""
    letters = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))
    numbered = F.transform(
        letters,
        lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i), lambda x: x == c)).cast("string")),
    )
    return F.when(F.size(letters) > 0, numbered).otherwise(F.array(F.lit("")))


def _bound(left: Column, right: Column) -> Column:
    """No ratio of two names is above this, given their marks."""
    shared = F.size(F.array_intersect(left, right))
    return 2.0 * shared / (F.size(left) + F.size(right))


def _indexed(names: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """(block, name, marks, prefix, mark): a row per mark of the prefix, rarest marks first.

    Of n marks more than n * t / (2 - t) have to be shared with any name of a ratio above t,
    so such a name has one of the others among its own rarest.
    """
    marks = names.select("block", "name", _marks(F.col("name")).alias("marks"))
    ranked = (
        marks.select("block", "name", "marks", F.explode("marks").alias("mark"))
        .join(counts, "mark")
        .groupBy("block", "name")
        .agg(F.first("marks").alias("marks"), F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("by"))
    )
    size = F.size("marks")
    shared = F.floor(size * (threshold / (2 - threshold)) - _SLACK)
    prefix = F.slice(F.transform("by", lambda m: m["mark"]), F.lit(1), (size - shared).cast("int"))
    return ranked.select("block", "name", "marks", prefix.alias("prefix")).select("*", F.explode("prefix").alias("mark"))


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(block, l, r, bound): of distinct (block, name) rows, all pairs of one block that can have
    a ratio above the threshold, and what it is at most. None is missing; a pair is given once."""
    counts = (
        left.select("name").unionByName(right.select("name"))
        .select(F.explode(_marks(F.col("name"))).alias("mark"))
        .groupBy("mark")
        .agg(F.count("*").alias("n"))
    )
    sides = [
        _indexed(names, counts, threshold).select(
            "block", "mark", F.col("name").alias(s), F.col("marks").alias(f"{s}_marks"), F.col("prefix").alias(f"{s}_prefix")
        )
        for names, s in ((left, "l"), (right, "r"))
    ]
    least = threshold / (2 - threshold) - _SLACK
    n, m = F.size("l_marks"), F.size("r_marks")
    met = F.get(F.array_intersect("l_prefix", "r_prefix"), F.lit(0))
    return (
        sides[0]
        .join(sides[1], ["block", "mark"])
        .where((n > least * m) & (m > least * n) & (F.col("mark") == met))
        .select("block", "l", "r", _bound(F.col("l_marks"), F.col("r_marks")).alias("bound"))
        .where(F.col("bound") > threshold - _SLACK)
    )


def _grams(name: Column, sizes: range) -> Column:
    def of(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(name) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(name, i, size))

    fitting = F.filter(F.lit(list(sizes)), lambda s: s <= F.char_length(name))
    return F.array_distinct(F.flatten(F.transform(fitting, of)))


def held_names(small: DataFrame, large: DataFrame) -> DataFrame:
    """(s, l): names of `small` that are part of a name of `large`. A name is looked up by the
    rarest of its n-grams; a name shorter than those by itself."""
    grams = large.select(F.col("name").alias("l"), F.explode(_grams(F.col("name"), range(_GRAM + 1))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.least(F.char_length("name"), F.lit(_GRAM))
    own = F.filter(_grams(F.col("name"), range(_GRAM + 1)), lambda g: F.char_length(g) == size)
    rarest = (
        small.select(F.col("name").alias("s"), F.explode(own).alias("gram"))
        .join(counts, "gram", "left")
        .groupBy("s")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    )
    return rarest.join(grams, "gram").where(F.contains("l", "s")).select("s", "l")


def match_tables(catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    """(a_table, b_table, score): the best table of side b above the threshold, the first by
    name of equally good ones."""
    plain = F.replace(F.lower("table"), F.lit("_"), F.lit("")).alias("name")
    a = catalog_a.where("table is not null").select(F.col("table").alias("a_table"), plain).distinct()
    b = catalog_b.where("table is not null").groupBy(plain).agg(F.min("table").alias("b_table"))
    names = [d.select(F.lit(0).alias("block"), "name").distinct() for d in (a, b)]
    pairs = (
        similar_names(*names, TABLE_THRESHOLD).select("l", "r")
        .unionByName(held_names(*names).select(F.col("s").alias("l"), F.col("l").alias("r")))
        .unionByName(held_names(*reversed(names)).select("l", F.col("s").alias("r")))
        .distinct()
    )
    best = (
        pairs.withColumn("score", _table_scores("l", "r"))
        .where(F.col("score") > TABLE_THRESHOLD)
        .join(b.withColumnRenamed("name", "r"), "r")
        .groupBy(F.col("l").alias("name"))
        .agg(F.min(F.struct((-F.col("score")).alias("less"), "b_table")).alias("m"))
    )
    return a.join(best, "name").select("a_table", "m.b_table", F.round(-F.col("m.less"), 6).alias("score"))


def match_fields(catalog_a: DataFrame, catalog_b: DataFrame, tables: DataFrame) -> DataFrame:
    """Best field of the matched table for every field of side a; null where none fits. Of
    equally good fields the first in the order of the table's fields is taken."""
    label = F.coalesce("label", F.lit("")).alias("label")
    fields = [c.select("table", "ordinal", "fieldname", label, "fieldtype") for c in (catalog_a, catalog_b)]
    rows = fields[0].withColumnRenamed("table", "a_table").join(tables.select("a_table", "b_table"), "a_table")
    title = F.lower("label").alias("title"), _marks(F.lower("label")).alias("title_marks")
    a = rows.distinct().select("*", F.lower("fieldname").alias("l"), *title)
    b = fields[1].join(tables.select(F.col("b_table").alias("table")).distinct(), "table").distinct()
    b = b.select(
        F.col("table").alias("b_table"), F.lower("fieldname").alias("r"),
        *[F.col(c).alias(f"b_{c}") for c in ("ordinal", "fieldname", "fieldtype")],
        *[c.alias(f"b_{n}") for c, n in zip(title, ("title", "title_marks"))],
    )
    names = [d.select(F.col("b_table").alias("block"), F.col(n).alias("name")).distinct() for d, n in ((a, "l"), (b, "r"))]
    pairs = similar_names(*names, _FIELD_NAME).withColumnRenamed("block", "b_table")
    kind = F.coalesce(type_score(F.col("fieldtype"), F.col("b_fieldtype")), F.lit(0.0))

    def total(name: Column, title: Column) -> Column:
        return NAME_WEIGHT * name + TYPE_WEIGHT * F.col("kind") + LABEL_WEIGHT * title

    possible = total(F.col("bound"), _bound(F.col("title_marks"), F.col("b_title_marks")))
    known = ["a_table", "b_table", "ordinal", "fieldname", "label", "fieldtype"]
    best = (
        a.join(pairs, ["b_table", "l"])
        .join(b, ["b_table", "r"])
        .withColumn("kind", kind)
        .where(F.col("kind") > 0)  # or no name and label reach the threshold
        .where(possible > FIELD_THRESHOLD - _SLACK)
        .withColumn("score", total(_ratios("l", "r"), _ratios("title", "b_title")))
        .where(F.col("score") > FIELD_THRESHOLD)
        .groupBy(*known)
        .agg(F.min(F.struct((-F.col("score")).alias("less"), "b_ordinal", "b_fieldname")).alias("m"))
    )
    found = best.select(*[F.col(c).alias(f"k_{c}") for c in known], "m")
    same = [rows[c].eqNullSafe(found[f"k_{c}"]) for c in known]
    return rows.join(found, same, "left").select(
        "a_table", "b_table", "ordinal", F.col("fieldname").alias("a_field"),
        F.col("m.b_fieldname").alias("b_field"), F.round(-F.col("m.less"), 6).alias("score"),
    )


def propose_mappings(fields: DataFrame) -> DataFrame:
    """One mapping per table pair; of several fields with one target, the last is reversed.

    `confidence` is the mapped share of the synced fields, which counts the same matches
    twice; `field_score` tells more.
    """
    hit = F.when(F.col("b_field").isNotNull(), F.struct("ordinal", "a_field", "b_field"))
    grouped = fields.groupBy("a_table", "b_table").agg(
        F.sort_array(F.collect_list(hit)).alias("hits"),
        F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("micros"),
        F.count("score").alias("n"),
    )
    # the mean of whole millionths, half up: no order of summing changes it
    mean = F.when(F.col("n") > 0, F.expr("(2 * micros + n) div (2 * n)") / 1_000_000)
    reverse = F.aggregate(
        "hits",
        F.expr("cast(map() as map<string,string>)"),
        lambda acc, h: F.map_concat(
            F.map_filter(acc, lambda k, _: k != h["b_field"]), F.create_map(h["b_field"], h["a_field"])
        ),
    )
    return grouped.select(
        F.concat_ws("_", "a_table", "b_table").alias("name"),
        "a_table",
        "b_table",
        F.transform("hits", lambda h: h["a_field"]).alias("sync_fields"),
        F.map_from_entries(
            F.transform("hits", lambda h: F.struct(h["a_field"], h["b_field"]))
        ).alias("field_mappings"),
        reverse.alias("reverse_mappings"),
        F.when(F.size("hits") > 0, 1.0).otherwise(0.0).alias("confidence"),
        mean.alias("field_score"),
    )


def compare_schemas(fields: DataFrame, catalog_b: DataFrame, tables: DataFrame) -> DataFrame:
    """Matches with their score, and the fields left over on either side."""
    of_pair = catalog_b.withColumnRenamed("table", "b_table").join(
        tables.select("a_table", "b_table"), "b_table"
    )
    used = fields.where("b_field is not null").select(
        "a_table", "b_table", F.col("b_field").alias("fieldname")
    )
    left_over = of_pair.join(used, ["a_table", "b_table", "fieldname"], "left_anti").select(
        "a_table",
        "b_table",
        F.lit(None).cast("string").alias("a_field"),
        F.col("fieldname").alias("b_field"),
        F.lit(None).cast("double").alias("score"),
        F.lit("only_b").alias("state"),
    )
    state = F.when(F.col("b_field").isNull(), "only_a").otherwise("mapped")
    return fields.select(
        "a_table", "b_table", "a_field", "b_field", "score", state.alias("state")
    ).unionByName(left_over)
