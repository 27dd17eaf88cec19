"""One sync batch: change events in, outcomes and merged target tables out.

    events -> route -> identity -> throttle and echo gate -> (per mapping and direction)
    map once -> match -> create/update/delete -> conflicts -> net changes -> merge

Deliveries of one event id are one event from the start; the others are duplicates. The gate
decides on narrow rows (ids, route, identity); its result is staged once and joined back to
the payloads per route, of which each route reads only its own source and entity. The mapped
rows of a route are staged, then the matched ones: the order of operations, the ledger and the merge
all start from them. Every delivery has one row in the ledger: applied, skipped with a reason,
or an error if its record cannot be read. Changes of several mappings of one target are
netted together and merged once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.identity import EMAIL_FIELDS, PHONE_FIELDS, dedup_identity
from tablesync.operators import conflict as cf
from tablesync.operators.apply import OP, apply_changes, net_changes
from tablesync.operators.dedup import DEFAULT_WINDOW_MS, gate_outcome
from tablesync.operators.events import (
    direction,
    json_filter_gate,
    mapping_gate,
    route,
    routes,
    typed_record,
)
from tablesync.operators.lookups import map_with_lookups
from tablesync.operators.mapping import ERRORS, PRESENT, conform, surrogate_key
from tablesync.operators.match import find_targets, resolve_operation
from tablesync.plans import conflicts as cr
from tablesync.profiles import A2B, B2A, MappingSpec, profile_of, sides
from tablesync.session import scratch, stage, stage_all, staging_in

# Reasons in the ledger.
REASONS = {
    "duplicate": "duplicate_webhook",
    "echo": "opposite_service_webhook_after_sync",
    "late": "late",
}
MISSING_KEY = {"email": "no_email_for_lookup", "subject": "no_task_name_for_lookup"}

_IDENTITY_FIELDS = tuple(
    dict.fromkeys(
        (
            *PHONE_FIELDS["any"],
            *EMAIL_FIELDS["any"],
            "subject",
            "task_name",
            "name",
            "title",
            "description",
            "page_content",
        )
    )
)
_LEDGER = (
    "event_id",
    "source",
    "entity",
    "record_id",
    "direction",
    "operation",
    "status",
    "reason",
    "target_id",
    "conflict_fields",
)


@dataclass(frozen=True)
class Side:
    """Record schema and current table of one entity in one system."""

    schema: str
    table: DataFrame


@dataclass
class SyncResult:
    """`targets` by (side, entity) are the tables after the batch; `tables` names the same ones
    by (mapping, direction). `conflicts` holds both records of each clash, `net` the net changes
    by (side, entity)."""

    ledger: DataFrame
    conflicts: DataFrame | None = None
    net: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    writes: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    tables: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    targets: dict[tuple[str, str], DataFrame] = field(default_factory=dict)


def one_per_event(events: DataFrame, *first: Column) -> DataFrame:
    """One row per event id, the first by `first`, then in the order of the columns (time, ...),
    and how many there were in `deliveries`."""
    rest = [c for c in events.columns if c not in ("event_id", "us")]
    order = [c.alias(f"_first{n}") for n, c in enumerate(first)]
    row = F.min(F.struct(*order, "us", *rest)).alias("_e")
    picked = events.where("event_id is not null").groupBy("event_id").agg(
        row, F.count(F.lit(1)).alias("deliveries")
    )
    return picked.select("event_id", "_e.us", *[f"_e.{c}" for c in rest], "deliveries")


def _outcome(rows: DataFrame, status: str, reason: Column) -> DataFrame:
    """Ledger rows of events that reach no target."""
    return rows.select(
        "event_id", "source", "entity", "record_id", "direction", "operation",
        F.lit(status).alias("status"), reason.alias("reason"),
        F.lit(None).cast("string").alias("target_id"),
        F.array().cast("array<string>").alias("conflict_fields"),
    )


def repeated(gate: DataFrame, unique: DataFrame) -> DataFrame:
    """Ledger rows of the deliveries that `one_per_event` left out."""
    again = unique.where("deliveries > 1").select("event_id", "deliveries")
    rows = gate.join(again, "event_id").withColumn(
        "_nth", F.explode(F.sequence(F.lit(2).cast("long"), F.col("deliveries")))
    )
    return _outcome(rows, "skipped", F.lit(REASONS["duplicate"]))


def late(events: DataFrame) -> DataFrame:
    """Ledger rows of events behind the watermark: what came after them is decided already."""
    return _outcome(events, "skipped", F.lit(REASONS["late"]))


def nameless(events: DataFrame) -> DataFrame:
    """Ledger rows of events without an id: they cannot be told apart, so none is applied."""
    rows = events.where("event_id is null").withColumn("direction", F.lit(None).cast("string"))
    return _outcome(rows, "error", F.lit("no_event_id"))


def with_identity(events: DataFrame, data: str, entity: str) -> DataFrame:
    """Adds the dedup identity from the JSON record, parsed once for the fields it needs."""
    names = [f"_json_{f}" for f in _IDENTITY_FIELDS]
    parsed = events.select("*", F.json_tuple(data, *_IDENTITY_FIELDS).alias(*names))
    identity = dedup_identity(
        F.col(entity), _IDENTITY_FIELDS, get=lambda f: F.col(f"_json_{f}")
    )
    return parsed.withColumn("identity", identity).drop(*names)


def admitted(events: DataFrame, specs: Sequence[MappingSpec], *extra: str) -> DataFrame:
    """Narrow rows: event_id, route, direction, identity and why a route refuses it."""
    routed = route(events, routes(events.sparkSession, specs)).withColumn(
        "kind", F.coalesce("a_type", "entity")
    )
    way = direction(F.col("source"), F.col("a_type"), F.col("b_table"), F.col("original_source"))
    filtered = F.lit(None).cast("string")
    for spec in specs:
        if spec.filters:
            mine = json_filter_gate(spec.filters, F.col("data"), F.col("operation"))
            filtered = F.when(F.col("mapping") == spec.name, mine).otherwise(filtered)
    return with_identity(routed, "data", "kind").select(
        "event_id",
        "source",
        "entity",
        "kind",
        "record_id",
        "operation",
        "mapping",
        way.alias("direction"),
        F.coalesce(
            F.col("reason"),
            mapping_gate(way, F.col("enabled"), F.col("allowed")),
            F.when(way.isNull(), "direction_not_allowed"),
            filtered,
        ).alias("refused"),
        "identity",
        *extra,
    )


def with_reason(outcome: DataFrame) -> DataFrame:
    """Why each event is skipped: the gate speaks before the route."""
    said = F.when(F.col("gate") == "duplicate", REASONS["duplicate"]).when(
        F.col("gate") == "echo", REASONS["echo"]
    )
    return outcome.select(
        "event_id", "us", "source", "entity", "record_id", "operation", "mapping", "direction",
        F.coalesce(said, F.col("refused")).alias("reason"),
    )


def gated(events: DataFrame, specs: Sequence[MappingSpec], window_ms: int) -> DataFrame:
    # staged: the gate reads these rows twice, and the records need not be parsed again
    slim = stage(admitted(events, specs, "us"), "admitted")
    outcome = gate_outcome(
        slim, entity="kind", may_succeed=F.col("refused").isNull(), window_ms=window_ms
    )
    return with_reason(outcome)


def mapped_rows(
    events: DataFrame,
    passed: DataFrame,
    spec: MappingSpec,
    way: str,
    source: Side,
    target: Side,
    dims: Mapping[str, DataFrame],
) -> DataFrame:
    """Records of one route in target shape."""
    src = profile_of(sides(way)[0])
    mine = passed.where((F.col("mapping") == spec.name) & (F.col("direction") == way))
    own = events.where(
        (F.col("source") == sides(way)[0]) & F.col("entity").isin(spec.a_type, spec.b_table)
    )
    rows = mine.join(own.select("event_id", "data"), "event_id")
    keep = ("event_id", "us", "record_id", "operation")
    rows = rows.select(*[F.col(c).alias(f"_{c}") for c in keep], "data")
    unreadable = F.json_object_keys("data").isNull() & (F.col("_operation") != "delete")
    rows = rows.withColumn("_malformed", unreadable)
    keep = (*keep, "malformed")
    records = typed_record(rows, source.schema, [f"_{c}" for c in keep])
    stamp = F.col(src.modified_col) if src.modified_col in records.columns else F.lit(None)
    records = records.withColumn("_stamp", stamp.cast("string"))
    kept = (*[f"_{c}" for c in keep], "_stamp")
    mapped = map_with_lookups(records, spec, way, dims, "_event_id", keep=kept)
    return conform(mapped, target.table)


def matched_rows(mapped: DataFrame, spec: MappingSpec, way: str, target: Side) -> DataFrame:
    """Mapped records of one route, each with the target row it belongs to."""
    dst = profile_of(sides(way)[1])
    payload = tuple(
        dict.fromkeys(
            [c for _, c in cf.compared_fields(spec, way) if c in target.table.columns]
            + ([dst.modified_col] if dst.modified_col in target.table.columns else [])
        )
    )
    found = find_targets(mapped, target.table, spec, way, dst.id_col, payload, salt="_event_id")
    # a record in error is nobody's predecessor and has no target
    found = found.withColumn("_error", _error(F.col("_malformed"), F.col(ERRORS), F.col("_operation")))
    broken = F.col("_error").isNotNull()
    for name in ("match_value", "target_id", "found_id"):
        found = found.withColumn(name, F.when(~broken, F.col(name)))
    return found


def _error(malformed: Column, errors: Column, op: Column) -> Column:
    lost = (F.size(errors) > 0) & (op != "delete")
    return F.when(malformed, "malformed_record").when(
        lost, F.concat(F.lit("unreadable_values: "), F.array_join(errors, "; "))
    )


def decide(
    found: DataFrame, spec: MappingSpec, way: str, *, slice_us: int = 3_600_000_000
) -> DataFrame:
    """Adds operation, status and reason to the matched rows of one route."""
    src, dst = (profile_of(s) for s in sides(way))
    is_delete = F.col("_operation") == "delete"
    known = F.when(is_delete, F.col("found_id")).otherwise(F.col("target_id")).isNotNull()
    found = resolve_operation(
        found,
        exists=known,
        micros="_us",
        id_col="_event_id",
        operation="_operation",
        slice_us=slice_us,
    )
    # a "create" here means that the batch has deleted the old target: nothing to clash with
    checked = cf.detect_conflicts(found, spec, way, operation="resolved", writing=("update",))
    theirs = f"t_{dst.modified_col}"
    target_stamp = (F.col(theirs) if theirs in checked.columns else F.lit(None)).cast("string")
    a_stamp, b_stamp = (F.col("_stamp"), target_stamp) if way == A2B else (target_stamp, F.col("_stamp"))
    incoming = F.lit(src.name)
    status, why = cf.conflict_status(F.col("strategy"), cf.newer_side(a_stamp, b_stamp), incoming)
    clash = F.size("conflict_fields") > 0
    no_key = MISSING_KEY.get(spec.match_keys[0].kind if spec.match_keys else "", "no_key_for_lookup")
    reason = F.when(
        is_delete,
        F.when(F.col("match_value").isNull(), no_key).when(~F.col("was_there"), "record_not_found"),
    ).when(clash, why)
    broken = F.col("_error").isNotNull()
    new_key = surrogate_key(spec.a_type, F.coalesce("match_value", "_record_id"))
    key = F.coalesce(F.when(is_delete, F.col("found_id")).otherwise(F.col("target_id")), new_key)
    return (
        checked.withColumn(
            "_status", F.when(broken, "error").when(clash, status).otherwise("success")
        )
        .withColumn("_reason", F.coalesce("_error", reason))
        .withColumn("_key", F.when(~broken, key))
        .withColumn("resolved", F.when(broken, F.col("_operation")).otherwise(F.col("resolved")))
    )


def written(decided: DataFrame, spec: MappingSpec, way: str, target: DataFrame) -> DataFrame:
    """The successful writes of one route, as changes of its target."""
    id_col = profile_of(sides(way)[1]).id_col
    columns = [c for c in spec_columns(decided, spec, way) if c in target.columns and c != id_col]
    return decided.where(
        (F.col("_status") == "success")
        & F.coalesce(F.col("_reason") != "record_not_found", F.lit(True))
        & ~((F.col("resolved") == "delete") & F.col("match_value").isNull())
    ).select(
        F.col("_key").alias(id_col),
        F.col("_us").alias("us"),
        F.col("_event_id").alias("event_id"),
        F.col("resolved").alias(OP),
        *columns,
        F.array_except(PRESENT, F.array(F.lit(id_col))).alias(PRESENT),
    )


def netted(changes: Sequence[DataFrame], target: DataFrame, id_col: str) -> DataFrame:
    """The net changes of all routes that lead to a target."""
    all_changes = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), changes)
    skip = {id_col, "us", "event_id", OP, PRESENT}
    columns = [c for c in target.columns if c in all_changes.columns and c not in skip]
    return net_changes(all_changes, id_col, columns=columns)


def spec_columns(decided: DataFrame, spec: MappingSpec, way: str) -> list[str]:
    names = dict.fromkeys([*spec.fields(way).values(), "email", "personal_email"])
    return [c for c in names if c in decided.columns]


def sync_batch(
    events: DataFrame,
    specs: Sequence[MappingSpec],
    a_sides: Mapping[str, Side],
    b_sides: Mapping[str, Side],
    *,
    window_ms: int = DEFAULT_WINDOW_MS,
    merge: bool = False,
    dims: Mapping[str, DataFrame] | None = None,
) -> SyncResult:
    """Outcomes of all events (event_id, us, source, entity, record_id, operation,
    original_source, data JSON); with `merge`, also the new target tables.

    `a_sides` by a_type and `b_sides` by b_table hold the record schema and the table
    before the batch; a mapping with a side missing is left to the ledger as refused. `dims`
    are the tables that lookups of the mappings ask, by name (see `operators.lookups`).
    """
    usable = usable_specs(specs, a_sides, b_sides)
    unique = stage(one_per_event(events), "events")
    passed = stage(gated(unique, usable, window_ms), "gated")
    result = settle(unique, passed, usable, a_sides, b_sides, merge=merge, dims=dims)
    result.ledger = result.ledger.unionByName(repeated(passed, unique)).unionByName(nameless(events))
    return result


def usable_specs(specs, a_sides: Mapping[str, Side], b_sides: Mapping[str, Side]):
    return [s for s in specs if s.a_type in a_sides and s.b_table in b_sides]


def settle(
    events: DataFrame,
    gate: DataFrame,
    usable: Sequence[MappingSpec],
    a_sides: Mapping[str, Side],
    b_sides: Mapping[str, Side],
    *,
    merge: bool = False,
    dims: Mapping[str, DataFrame] | None = None,
    read_often: bool = False,
) -> SyncResult:
    """Everything after the gate, for gate rows with their reason (see `with_reason`). With `read_often`
    the decided rows are staged too, for who reads ledger, net changes and conflicts; what they were made
    from is removed."""
    skipped = _outcome(gate.where("reason is not null"), "skipped", F.col("reason"))
    passed = gate.where("reason is null")
    result = SyncResult(skipped)
    parts = [skipped]
    ends = {
        (s.name, way): (a_sides[s.a_type], b_sides[s.b_table])[:: 1 if way == A2B else -1]
        for s in usable
        for way in (A2B, B2A)
        if s.allows(way)
    }
    by_name = {s.name: s for s in usable}
    spark = events.sparkSession
    with scratch(spark, "matched", read_often) as outside:
        # matching asks for keys, texts and rows: staged before, each record is read and mapped once
        with scratch(spark, "mapped", read_often) as for_matched:
            mapped = stage_all(
                {
                    f"mapped-{way}-{n}": mapped_rows(events, passed, by_name[n], way, *ends[n, way], dims or {})
                    for n, way in ends
                }
            )
            with staging_in(for_matched):
                found = stage_all(
                    {
                        f"matched-{way}-{n}": matched_rows(mapped[f"mapped-{way}-{n}"], by_name[n], way, ends[n, way][1])
                        for n, way in ends
                    }
                )
        decided = {f"decided-{way}-{n}": decide(found[f"matched-{way}-{n}"], by_name[n], way) for n, way in ends}
        if read_often:
            with staging_in(outside):
                decided = stage_all(decided)
    clashes: list[DataFrame] = []
    leads_to: dict[tuple[str, str], tuple[str, str]] = {}
    changes: dict[tuple[str, str], list[DataFrame]] = {}
    goals: dict[tuple[str, str], DataFrame] = {}
    for name, way in ends:
        spec, (source, target) = by_name[name], ends[name, way]
        rows = decided[f"decided-{way}-{name}"]
        result.writes[spec.name, way] = rows
        clashes.append(cr.conflict_rows(rows, spec, way, spec_columns(rows, spec, way)))
        parts.append(
            rows.select(
                F.col("_event_id").alias("event_id"),
                F.lit(sides(way)[0]).alias("source"),
                F.lit(spec.a_type if way == A2B else spec.b_table).alias("entity"),
                F.col("_record_id").alias("record_id"),
                F.lit(way).alias("direction"),
                F.col("resolved").alias("operation"),
                F.col("_status").alias("status"),
                F.col("_reason").alias("reason"),
                F.when(
                    (F.col("resolved") != "delete") | F.col("was_there"), F.col("_key")
                ).alias("target_id"),
                "conflict_fields",
            )
        )
        side = sides(way)[1]
        place = side, spec.a_type if side == "a" else spec.b_table
        leads_to[spec.name, way] = place
        changes.setdefault(place, []).append(written(rows, spec, way, target.table))
        goals[place] = target.table
    if merge:
        for place, parts_of in changes.items():
            id_col = profile_of(place[0]).id_col
            result.net[place] = netted(parts_of, goals[place], id_col)
            result.targets[place] = apply_changes(goals[place], result.net[place], id_col)
        result.tables = {route: result.targets[place] for route, place in leads_to.items()}
    result.ledger = reduce(DataFrame.unionByName, [p.select(*_LEDGER) for p in parts])
    none = events.sparkSession.createDataFrame([], cr.SCHEMA)
    result.conflicts = reduce(DataFrame.unionByName, clashes, none)
    return result
