"""Change events: normalisation of both landing shapes, routing and gates."""

from __future__ import annotations

import json
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.text import non_empty
from tablesync.operators.mapping import PRESENT
from tablesync.profiles import A2B, B2A, MappingSpec

# Operation words of both landing shapes; anything else is an update.
OPERATION_WORDS = {
    "after_insert": "create",
    "after_update": "update",
    "after_delete": "delete",
    "INSERT": "create",
    "UPDATE": "update",
    "DELETE": "delete",
}
# Id prefixes that tell the entity type of a side-a record.
ID_PREFIXES = {"TASK-": "Task", "HR-EMP-": "Employee", "PROJ-": "Project"}
DEFAULT_TYPE = "Employee"

OUTCOME_NOT_CONFIGURED = {"a": "doctype_not_configured", "b": "table_not_configured"}


def operation(raw: Column) -> Column:
    pairs = [F.lit(x) for p in OPERATION_WORDS.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), F.lit("update"))


def entity_type(declared: Column, record_name: Column) -> Column:
    """The declared type, else by id prefix, else the default type."""
    guess = F.when(F.lit(False), F.lit(""))
    for prefix, kind in ID_PREFIXES.items():
        guess = guess.when(record_name.startswith(prefix), kind)
    return F.coalesce(non_empty(declared), guess.otherwise(DEFAULT_TYPE))


def _parsed(landed: DataFrame, payload: str, *names: str):
    """The rows with the named fields of their JSON, all from one reading, and how to get them."""
    taken = [f"_json_{n}" for n in names]
    rows = landed.select("*", F.json_tuple(payload, *names).alias(*taken))
    return rows, lambda name: F.col(f"_json_{name}")


def normalize_a(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat JSON records of side a -> events (id, source, entity, record_id, operation)."""
    rows, get = _parsed(landed, payload, "operation", "name", "employee", "doctype", "webhook_id")
    raw = F.coalesce(get("operation"), F.lit("after_update"))
    name = F.coalesce(get("name"), get("employee"), F.lit("unknown"))
    entity = entity_type(get("doctype"), F.coalesce(get("name"), F.lit("")))
    return rows.select(
        *landed.columns,
        F.concat_ws("_", F.lit("a"), entity, name, raw).alias("id"),
        F.lit("a").alias("source"),
        entity.alias("entity"),
        name.alias("record_id"),
        operation(raw).alias("operation"),
        get("webhook_id").alias("webhook_id"),
        F.lit("a").alias("original_source"),
        F.col(payload).alias("data"),
        present_keys(F.col(payload)).alias(PRESENT),
    )


def normalize_b(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Table-change JSON of side b: {type, table, record, old_record}.

    A delete may carry its row in `old_record` only.
    """
    rows, get = _parsed(landed, payload, "type", "table", "record", "old_record", "webhook_id")
    record = F.coalesce(get("record"), get("old_record"))
    record_id = F.get_json_object(record, "$.id")
    return rows.select(
        *landed.columns,
        F.concat_ws("_", F.lit("b"), get("table"), F.coalesce(record_id, F.lit("None")), get("type"))
        .alias("id"),
        F.lit("b").alias("source"),
        get("table").alias("entity"),
        F.coalesce(record_id, F.lit("None")).alias("record_id"),
        operation(get("type")).alias("operation"),
        get("webhook_id").alias("webhook_id"),
        F.lit("b").alias("original_source"),
        record.alias("data"),
        present_keys(record).alias(PRESENT),
    )


def present_keys(json: Column) -> Column:
    """Top-level keys of a record: a key with a null value is present."""
    return F.json_object_keys(json)


def routes(spark: SparkSession, specs: Iterable[MappingSpec]) -> DataFrame:
    """(source, entity) -> mapping; the first spec of a type or table wins."""
    rows: dict[tuple[str, str], tuple] = {}
    for s in specs:
        tail = (s.name, s.a_type, s.b_table, s.enabled, s.direction)
        rows.setdefault(("a", s.a_type), tail)
        rows.setdefault(("b", s.b_table), tail)
    schema = (
        "source string, entity string, mapping string, a_type string, b_table string, "
        "enabled boolean, allowed string"
    )
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], schema)


def route(events: DataFrame, table: DataFrame) -> DataFrame:
    """Adds the mapping of each event, or the reason why it has none.

    The routes are a few rows of configuration and go to the events: a shuffle by source and entity would
    meet in a task per entity, however many events there are.
    """
    out = events.join(F.broadcast(table), ["source", "entity"], "left")
    missing = F.when(F.col("source") == "a", OUTCOME_NOT_CONFIGURED["a"]).otherwise(
        OUTCOME_NOT_CONFIGURED["b"]
    )
    return out.withColumn("reason", F.when(F.col("mapping").isNull(), missing))


def direction(source: Column, a_type: Column, b_table: Column, original: Column) -> Column:
    """a2b / b2a, or null: no target on the other side, or the change came from there."""
    way = F.when((source == "a") & non_empty(b_table).isNotNull(), A2B).when(
        (source == "b") & non_empty(a_type).isNotNull(), B2A
    )
    returns = original.isin("a", "b") & (original != source)
    return F.when(~F.coalesce(returns, F.lit(False)), way)


def mapping_gate(way: Column, enabled: Column, allowed: Column) -> Column:
    """Reason to skip an event because of its mapping's own switches, or null."""
    return F.when(~F.coalesce(enabled, F.lit(True)), "mapping_disabled").when(
        ~allowed.isin("bidirectional") & (allowed != way), "direction_not_allowed"
    )


def filter_gate(filters: Mapping[str, object]) -> Column:
    """Equality filters of a mapping, on the record's own fields."""
    keep = F.lit(True)
    for name, value in filters.items():
        keep = keep & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return F.when(~keep, "filtered_out")


def json_filter_gate(filters: Mapping[str, object], data: Column, op: Column) -> Column:
    """The same filters on a record that is still JSON text. A delete may carry its id alone: a
    field that it lacks does not keep it back."""
    keep = F.lit(True)
    for name, value in filters.items():
        found = F.get_json_object(data, f"$['{name}']")
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            same = found.try_cast("double") == F.lit(float(value))
        else:
            same = found == F.lit(value if isinstance(value, str) else json.dumps(value))
        keep = keep & F.coalesce(same, op == "delete")
    return F.when(~F.coalesce(keep, F.lit(False)), "filtered_out")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Change rows between two snapshots: created, updated and deleted records.

    A deletion carries the key only; `changed` lists the differing columns.
    """
    values = [c for c in new.columns if c != key]
    before = old.select(F.col(key).alias("_k"), F.struct(*values).alias("_old"))
    after = new.select(F.col(key).alias("_j"), F.struct(*values).alias("_new"))
    both = before.join(after, F.col("_k") == F.col("_j"), "full_outer")
    differs = [
        F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in values
    ]
    op = (
        F.when(F.col("_k").isNull(), "create")
        .when(F.col("_j").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    return (
        both.withColumn("operation", op)
        .where("operation is not null")
        .select(
            F.coalesce("_k", "_j").alias(key),
            "operation",
            F.when(op == "update", F.array_compact(F.array(*differs))).alias("changed"),
            *[F.col(f"_new.{c}").alias(c) for c in values],
        )
    )


def event_rows(changes: DataFrame, source: str, entity: str, key: str) -> DataFrame:
    """Direct-change events: no original source, a delete carries only its id."""
    data = [c for c in changes.columns if c not in (key, "operation", "changed")]
    record = F.to_json(F.struct(key, *data), {"ignoreNullFields": "false"})
    bare = F.to_json(F.struct(key))
    return changes.select(
        F.concat_ws("_", F.lit(source), F.lit(entity), F.col(key), F.col("operation")).alias("id"),
        F.lit(source).alias("source"),
        F.lit(entity).alias("entity"),
        F.col(key).cast("string").alias("record_id"),
        "operation",
        F.when(F.col("operation") == "delete", bare).otherwise(record).alias("data"),
        F.lit(None).cast("string").alias("original_source"),
    )


def typed_record(
    events: DataFrame, schema: str, keep: Sequence[str], data: str = "data"
) -> DataFrame:
    """JSON records as typed columns plus the presence mask."""
    parsed = events.select(
        *keep, F.from_json(data, schema).alias("_r"), present_keys(F.col(data)).alias(PRESENT)
    )
    return parsed.select(*keep, "_r.*", PRESENT)
