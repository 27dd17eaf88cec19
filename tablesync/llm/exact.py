"""Exact dedup: texts that are equal but for white space, found without a hot group's rows
ever meeting in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, WHITE_CLASS, pack, sha256, unpack
from tablesync.session import stage

_ROW = ("doc_id", *KEY, "digest", "chars")


def without_white(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+", "")


def copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 32) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, digest and
    the row's hashes k1, k2.

    A digest that one row alone has needs no comparison. The texts of all others are combined in
    three stages, each of which groups by the digest and the whole normalised text: within a
    task before anything is moved, then per salt, then over the salts' winners. So a group
    that holds a third of all rows costs one row per task, then one per salt; and texts that
    share a digest but differ stay apart, whatever the digest.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null
    last), then the smallest row hashes. Of repeated equal rows one stays. Null text is an
    empty one; blank and empty texts are one group. Empty table: no rows.
    """
    rows = pack(docs, "doc_id", "text").select(
        "doc_id", *KEY,
        without_white(F.col("text")).alias("normal"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"),
    )
    rows = rows.withColumn("digest", digest(F.col("normal")))
    counted = stage(rows.groupBy(*_ROW).agg(F.count("*").alias("rows")), "exact-rows")
    shared = stage(
        counted.groupBy("digest").agg(F.sum("rows").alias("n")).filter("n > 1").select("digest"), "exact-shared"
    )
    alone = counted.join(shared, "digest", "left_anti")
    # shuffled at every size: a broadcast would fit small tables only
    texts = stage(rows.join(shared.hint("merge"), "digest", "left_semi").select(*_ROW, "normal"), "exact-texts")
    rank = F.struct(
        (-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"), F.col("k1").alias("w1"), F.col("k2").alias("w2"),
    )
    salted = texts.groupBy("digest", "normal", F.pmod(F.col("k1"), F.lit(salts)).alias("salt")).agg(
        F.min(rank).alias("best"), F.count("*").alias("n")
    )
    groups = stage(
        salted.groupBy("digest", "normal").agg(F.min("best").alias("best"), F.sum("n").alias("group_size")),
        "exact-groups",
    )
    members = (
        texts.join(groups, ["digest", "normal"])
        .groupBy("doc_id", *KEY, "digest", "best.id", "best.w1", "best.w2", "group_size")
        .agg(F.count("*").alias("rows"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    )
    stays = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & (F.col("nth") == 1)
    return alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest", *KEY,
    ).unionByName(
        members.select("doc_id", F.col("id").alias("keep_id"), "group_size", stays.alias("kept"), "digest", *KEY)
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of repeated rows one."""
    kept = stage(copies(docs, **options).filter("kept").select(*KEY).dropDuplicates(), "exact-kept")
    rows = pack(docs, "doc_id").join(kept, [*KEY], "left_semi")
    return unpack(rows.groupBy(*KEY).agg(F.any_value("_row").alias("_row")), docs.columns)
