"""Applying mapped changes to a target table as one merge."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.operators.mapping import PRESENT

OP = "operation"


def net_changes(
    changes: DataFrame,
    key: str,
    order: Sequence[str] = ("us", "event_id"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key with the effect of all its changes played in order.

    Per column the latest value written after the last delete; `_present` lists the
    columns written, `_reset` tells that the old row is gone first, `operation` is the
    last one. A single aggregate with partial combining: no window, no collected group,
    so a key with a third of all changes is as cheap as any other.
    """
    skip = {key, OP, PRESENT, "_errors", *order}
    columns = [c for c in changes.columns if c not in skip] if columns is None else list(columns)
    at = F.struct(*order)
    is_delete = F.col(OP) == "delete"
    masked = PRESENT in changes.columns

    def written(column: str) -> Column:
        has = F.array_contains(PRESENT, column) if masked else F.lit(True)
        return F.max(F.when(~is_delete & has, F.struct(at.alias("at"), F.lit(True).alias("_w"))))

    def value(column: str) -> Column:
        has = F.array_contains(PRESENT, column) if masked else F.lit(True)
        return F.max_by(F.struct(F.col(column).alias("v")), F.when(~is_delete & has, at))

    aggs = [
        F.max(F.when(is_delete, at)).alias("_deleted"),
        F.max_by(OP, at).alias("_op"),
        F.count(F.lit(1)).alias("n_changes"),
    ]
    for c in columns:
        aggs += [written(c).alias(f"_at_{c}"), value(c).alias(f"_v_{c}")]
    rows = changes.groupBy(key).agg(*aggs)

    def alive(column: str) -> Column:
        stamp = F.col(f"_at_{column}.at")
        return F.coalesce(
            stamp.isNotNull() & (F.col("_deleted").isNull() | (stamp > F.col("_deleted"))),
            F.lit(False),
        ) & (F.col("_op") != "delete")

    return rows.select(
        key,
        F.col("_op").alias(OP),
        "n_changes",
        F.col("_deleted").isNotNull().alias("_reset"),
        *[F.when(alive(c), F.col(f"_v_{c}.v")).alias(c) for c in columns],
        F.array_compact(F.array(*[F.when(alive(c), F.lit(c)) for c in columns])).alias(PRESENT),
    )


def apply_changes(target: DataFrame, net: DataFrame, key: str) -> DataFrame:
    """The target after the net changes: one full outer join on the key.

    Columns a change did not write keep their value, unless the row was deleted on the
    way; columns only the target has stay as they are. Applying the same changes twice
    gives the same table.
    """
    fields = [c for c in net.columns if c in target.columns and c != key]
    side = net.select(
        F.col(key).alias("_key"),
        F.col(OP).alias("_op"),
        F.col("_reset"),
        F.col(PRESENT).alias("_mask"),
        *[F.col(c).alias(f"_new_{c}") for c in fields],
    )
    joined = target.join(side, target[key] == side["_key"], "full_outer").where(
        F.col("_op").isNull() | (F.col("_op") != "delete")
    )
    hit = F.col("_key").isNotNull()
    reset = F.coalesce("_reset", F.lit(False))
    out = []
    for c in target.columns:
        old = F.when(~reset, F.col(c))
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_key")).alias(key))
        elif c in fields:
            writes = hit & F.array_contains("_mask", c)
            out.append(F.when(writes, F.col(f"_new_{c}")).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return joined.select(*out)


def write_key(target_id: Column, surrogate: Column) -> Column:
    """Existing rows keep their id; new ones get the deterministic surrogate."""
    return F.coalesce(target_id, surrogate)


def delete_outcome(lookup_value: Column, target_id: Column, missing_reason: str) -> tuple[Column, Column]:
    """(deleted, reason) of a delete looked up in the target."""
    reason = F.when(lookup_value.isNull(), missing_reason).when(
        target_id.isNull(), "record_not_found"
    )
    return reason.isNull(), reason
