"""Conflict detection between an incoming record and its target, and resolution."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.render import to_utc
from tablesync.functions.text import non_empty
from tablesync.profiles import STRATEGIES, A2B, MappingSpec


def conflict_fields(pairs: Mapping[str, tuple[Column, Column]]) -> Column:
    """Names of the fields that both sides have a value for, and a different one."""
    return F.array_compact(
        F.array(*[F.when(mine != theirs, F.lit(name)) for name, (mine, theirs) in pairs.items()])
    ) if pairs else F.array().cast("array<string>")


def compared_fields(
    spec: MappingSpec, direction: str, *, compat_same_name: bool = False
) -> list[tuple[str, str]]:
    """(reported name, target column) of the fields to compare, in target shape.

    By default each synced field is followed through the mapping; `compat_same_name`
    compares only fields spelled alike on both sides.
    """
    if compat_same_name:
        return [(f, f) for f in spec.sync_fields]
    fields = spec.fields(direction)
    wanted = spec.sync_fields if direction == A2B else list(fields)
    return [(f, fields[f]) for f in wanted if f in fields]


def detect_conflicts(
    matched: DataFrame,
    spec: MappingSpec,
    direction: str,
    *,
    target_prefix: str = "t_",
    operation: str = "operation",
    writing: Sequence[str] = ("create", "update"),
    compat_same_name: bool = False,
) -> DataFrame:
    """Adds `conflict_fields` (empty: none) and `strategy` to matched incoming rows."""
    if spec.strategy not in STRATEGIES:
        raise ValueError(f"unknown conflict strategy {spec.strategy!r}")
    pairs = {
        name: (F.col(column), F.col(f"{target_prefix}{column}"))
        for name, column in compared_fields(spec, direction, compat_same_name=compat_same_name)
        if column in matched.columns and f"{target_prefix}{column}" in matched.columns
    }
    writes = F.col("target_id").isNotNull() & F.col(operation).isin(*writing)
    return matched.withColumn(
        "conflict_fields",
        F.when(writes, conflict_fields(pairs)).otherwise(F.array().cast("array<string>")),
    ).withColumn("strategy", F.lit(spec.strategy))


def newer_side(a_stamp: Column, b_stamp: Column, *, compat_lexicographic: bool = False) -> Column:
    """'a' if a changed strictly later; a tie, or no stamp on a, goes to 'b'.

    Stamps are compared as instants; `compat_lexicographic` compares them as text.
    """
    a, b = non_empty(a_stamp), non_empty(b_stamp)
    later = a > b if compat_lexicographic else to_utc(a) > to_utc(b)
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.when(F.coalesce(later, F.lit(False)), "a").otherwise("b"))
        .when(a.isNotNull(), "a")
        .otherwise("b")
    )


def last_modified(
    has_a: Column, has_b: Column, a_stamp: Column, b_stamp: Column, *, compat_lexicographic: bool = False
) -> Column:
    """Winner by change stamp; a side without data loses to the other."""
    newer = newer_side(a_stamp, b_stamp, compat_lexicographic=compat_lexicographic)
    return F.when(~has_a & ~has_b, None).when(~has_b, "a").when(~has_a, "b").otherwise(newer)


def winner(strategy: Column, newer: Column) -> Column:
    """'a', 'b' or null where a person has to decide."""
    return (
        F.when(strategy == "last_modified_wins", newer)
        .when(strategy == "a_wins", "a")
        .when(strategy == "b_wins", "b")
    )


def conflict_status(strategy: Column, newer: Column, incoming: Column) -> tuple[Column, Column]:
    """(status, reason) of a conflicting write: the winner's data is what stays.

    If the target's side wins there is nothing to write.
    """
    side = winner(strategy, newer)
    status = F.when(side.isNull(), "conflict").when(side == incoming, "success").otherwise("skipped")
    reason = F.when(side.isNull(), "manual_resolution").when(side != incoming, "target_wins")
    return status, reason


def resolve_pairs(
    pairs: DataFrame, a_stamp: str, b_stamp: str, configured: Column, values: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Picks one side's values per pair: (output, a column, b column); tie goes to b."""
    a, b = to_utc(non_empty(F.col(a_stamp))), to_utc(non_empty(F.col(b_stamp)))
    a_newer = F.coalesce(a > b, a.isNotNull() & b.isNull())
    side = F.when(a_newer, "a").otherwise("b")
    return pairs.select(
        "*",
        F.when(configured, side).alias("winner"),
        F.when(~configured, "no_mapping").alias("error"),
        *[
            F.when(configured & a_newer, F.col(x)).when(configured, F.col(y)).alias(out)
            for out, x, y in values
        ],
    )
