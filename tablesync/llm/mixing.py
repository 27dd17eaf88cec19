"""Mixing sources to target weights: every document gets a whole number of copies, drawn so
that each source comes near its share of the mix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, WORD, pack, unpack
from tablesync.session import stage

FAN_IN = 64  # residuals that one node of the reduction tree pairs up
_EPSILON = 1e-9
_UNIT = "struct<draw:bigint,k1:bigint,k2:bigint,p:double,size:bigint>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) -> the same with weight and target.

    Sources by code point, null last, take the weights in turn and divide `share` of all sizes.
    No target is above `most` times its source's size; what is above goes to the others by
    weight. That ends at one level of target per weight, below which no source is cut: with
    sources ordered by the level at which they reach their limit, the first one that the
    remaining total does not fill sets it. The table has one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.lit(list(map(float, weights))), (turn + 1).cast("int")))
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(behind))
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
        .withColumn("level", F.max("open").over(everything))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "weight", "target")
    )


def _uniform(seed: int, level: int, k1: Column, k2: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the row and the place in the tree."""
    bits = F.xxhash64(F.lit(seed), F.lit(level), k1, k2).bitwiseAND(F.lit((1 << 53) - 1))
    return bits.cast("double") / F.lit(float(1 << 53))


def _transfer(level: int, seed: int) -> Column:
    """Folds the units of one node, in the order of their draws, into settled units and one
    residual. Each step moves mass (probability x size) between the residual and the next unit
    until one of the two is 0 or 1; the odds of the direction keep both expectations."""

    def step(state: Column, unit: Column) -> Column:
        a = state["held"]
        up = F.least((1 - a["p"]) * a["size"], unit["p"] * unit["size"])  # mass a can gain
        down = F.least(a["p"] * a["size"], (1 - unit["p"]) * unit["size"])  # mass a can lose
        gain = _uniform(seed, level, unit["k1"], unit["k2"]) * (up + down) < down
        mass = F.when(gain, up).otherwise(-down)
        pa, pb = a["p"] + mass / a["size"], unit["p"] - mass / unit["size"]

        def whole(p: Column) -> Column:
            return (p < _EPSILON) | (p > 1 - _EPSILON)

        def with_p(of: Column, p: Column) -> Column:
            return F.struct(
                of["draw"].alias("draw"), of["k1"].alias("k1"), of["k2"].alias("k2"),
                F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), of["size"].alias("size"),
            )

        left, right = with_p(a, pa), with_p(unit, pb)
        settled = F.when(whole(pa) & whole(pb), F.array(left, right)).when(whole(pa), F.array(left)).otherwise(F.array(right))
        held = F.when(whole(pa) & whole(pb), F.lit(None)).when(whole(pa), right).otherwise(left)
        return F.when(
            a.isNull(), F.struct(unit.alias("held"), state["settled"].alias("settled"))
        ).otherwise(F.struct(held.alias("held"), F.concat(state["settled"], settled).alias("settled")))

    start = F.struct(
        F.lit(None).cast(_UNIT).alias("held"), F.array().cast(f"array<{_UNIT}>").alias("settled")
    )
    return F.aggregate("of_node", start, step)


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 1,
) -> DataFrame:
    """One row per distinct row of `docs` (doc_id, source, text): k1, k2, doc_id, size (words),
    source, source_size, target, rows (equal rows it stands for) and copies (of all of them
    together).

    A row's expected copies are target / source_size: the whole part is certain, the fraction
    is rounded by pairing. Nodes of a reduction tree hold about FAN_IN fractional units of one
    source each, however large the source; a node settles all but one and hands that up, until
    one per source is left, which is drawn. So a source misses its target by less than the size
    of one document, no document is taken more than ceil(most) times, and the same rows
    give the same mix on any cluster.

    Equal rows are one unit that is rounded together. Null text or source are an empty text and
    a source of its own, the last. Documents without words get the whole part of their expected
    copies, and those of a source without words none. Empty table: no rows.
    """
    units = (
        pack(docs, "doc_id", "source", "text")
        .select(*KEY, "doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy(*KEY, "doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
    )
    units = stage(units, "mix-units")
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")
    )
    targets = stage(
        source_targets(sums.select("source", "source_size"), weights, share, most)
        .join(sums.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s"),
        "mix-targets",
    )
    largest = targets.agg(F.max("units")).first()[0] or 1
    named = targets.withColumnRenamed("source", "named")
    rated = (
        units.join(named, F.col("source").eqNullSafe(F.col("named")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("expected", F.col("rate") * F.col("rows"))
        .withColumn("base", F.floor(F.col("expected") + _EPSILON))
        .withColumn("p", F.greatest(F.col("expected") - F.col("base"), F.lit(0.0)))
    )
    level, settled = 0, []
    open_units = rated.filter((F.col("p") > _EPSILON) & (F.col("size") > 0)).select(
        "source", "units", *KEY, "p", "size"
    )
    width = largest
    while width > 1:
        width = math.ceil(width / FAN_IN)
        draw = F.xxhash64(F.lit(seed), F.lit(-1 - level), *KEY)
        nodes = F.greatest(F.lit(1), F.ceil(F.col("units") / F.lit(float(FAN_IN))))
        drawn = open_units.select(
            "source", nodes.alias("units"), F.pmod(draw, nodes).alias("node"),
            F.struct(draw.alias("draw"), *KEY, "p", "size").alias("unit"),
        )
        folded = stage(
            drawn.groupBy("source", "units", "node")
            .agg(F.sort_array(F.collect_list("unit")).alias("of_node"))
            .select("source", "units", _transfer(level, seed).alias("done")),
            f"mix-level{level}",
        )
        settled.append(folded.select(F.explode("done.settled").alias("u")).select("u.k1", "u.k2", F.round("u.p").cast("long").alias("up")))
        open_units = folded.filter("done.held is not null").select(
            "source", "units", "done.held.k1", "done.held.k2", "done.held.p", "done.held.size"
        )
        level += 1
    last = open_units.select(*KEY, (_uniform(seed, level, F.col("k1"), F.col("k2")) < F.col("p")).cast("long").alias("up"))
    for part in settled:
        last = last.unionByName(part)
    return rated.join(last, [*KEY], "left").select(
        *KEY, "doc_id", "source", "size", "source_size", "target", "rows",
        (F.col("base") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"),
    )


def taken(decisions: DataFrame) -> DataFrame:
    """The decisions per row: equal rows share their copies as evenly as they can."""
    each, over = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    return (
        decisions.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .withColumn("copies", (each + (F.col("nth") <= over).cast("long")).cast("long"))
        .drop("nth", "rows")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row repeated as often as the mix takes it; rows not taken are gone."""
    decided = copies(docs, **options).filter("copies > 0").select(*KEY, "copies")
    one_each = pack(docs, "doc_id").groupBy(*KEY).agg(F.any_value("_row").alias("_row"))
    repeated = one_each.join(stage(decided, "mix-decided"), [*KEY]).select(
        "_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")
    )
    return unpack(repeated, docs.columns)
