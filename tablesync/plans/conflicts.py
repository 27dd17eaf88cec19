"""Conflicts as records that a person can settle: both sides' values, kept until a decision
is joined to them and played through the merge."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.apply import OP, apply_changes, net_changes
from tablesync.operators.mapping import PRESENT
from tablesync.profiles import MappingSpec, profile_of, sides

SCHEMA = (
    "event_id bigint, us bigint, mapping string, direction string, side string, entity string, "
    "record_id string, target_id string, strategy string, status string, conflict_fields array<string>, "
    "incoming string, existing string, written array<string>"
)
# What a decision can say.
INCOMING, TARGET = "incoming", "target"


def conflict_rows(rows: DataFrame, spec: MappingSpec, way: str, columns: list[str]) -> DataFrame:
    """The decided rows of a route that clash with their target, both records as JSON in target
    shape: `incoming` as it would be written, `existing` as far as it was compared."""
    side = sides(way)[1]
    id_col = profile_of(side).id_col
    theirs = [c for c in rows.columns if c.startswith("t_")]
    return rows.where(F.size("conflict_fields") > 0).select(
        F.col("_event_id").alias("event_id"), F.col("_us").alias("us"), F.lit(spec.name).alias("mapping"),
        F.lit(way).alias("direction"), F.lit(side).alias("side"),
        F.lit(spec.a_type if side == "a" else spec.b_table).alias("entity"),
        F.col("_record_id").alias("record_id"), F.col("_key").alias("target_id"), "strategy",
        F.col("_status").alias("status"), "conflict_fields",
        F.to_json(F.struct(*[c for c in columns if c != id_col])).alias("incoming"),
        F.to_json(F.struct(*[F.col(c).alias(c[len("t_"):]) for c in theirs])).alias("existing"),
        F.array_except(PRESENT, F.array(F.lit(id_col))).alias("written"),
    )


def pending(conflicts: DataFrame) -> DataFrame:
    """Those that wait for a person."""
    return conflicts.where(F.col("status") == "conflict")


def decided(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The pending conflicts with their `decision`, for decisions (event_id, mapping, winner).

    Only the first decision of a conflict by winner counts, if several differ; one that names
    neither side leaves the conflict pending, as does none.
    """
    said = (
        decisions.where(F.col("winner").isin(INCOMING, TARGET))
        .groupBy("event_id", "mapping")
        .agg(F.min("winner").alias("decision"))
    )
    return pending(conflicts).join(said, ["event_id", "mapping"], "left")


def settlements(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger rows of the conflicts that a decision ends."""
    ended = decided(conflicts, decisions).where("decision is not null")
    wins = F.col("decision") == INCOMING
    return ended.select(
        "event_id", "mapping", "entity", "record_id", "target_id",
        F.when(wins, "success").otherwise("skipped").alias("status"),
        F.when(wins, "manual_incoming").otherwise("manual_target").alias("reason"),
    )


def resolve_manual(
    conflicts: DataFrame, decisions: DataFrame, targets: Mapping[tuple[str, str], DataFrame]
) -> dict[tuple[str, str], DataFrame]:
    """The tables (side, entity) after the decisions: what was decided for is written as its event
    would have been, in the order of the events, by the same net changes and merge."""
    wins = decided(conflicts, decisions).where(F.col("decision") == INCOMING)
    after = {}
    for (side, entity), target in targets.items():
        id_col = profile_of(side).id_col
        kinds = T.StructType([f for f in target.schema.fields if f.name != id_col])
        changes = wins.where((F.col("side") == side) & (F.col("entity") == entity)).select(
            F.col("target_id").cast(target.schema[id_col].dataType).alias(id_col), "us", "event_id",
            F.lit("update").alias(OP), F.from_json("incoming", kinds).alias("_r"), F.col("written").alias(PRESENT),
        )
        names = [f.name for f in kinds.fields]
        flat = changes.select(id_col, "us", "event_id", OP, PRESENT, *[F.col(f"_r.{n}").alias(n) for n in names])
        after[side, entity] = apply_changes(target, net_changes(flat, id_col, columns=names), id_col)
    return after
