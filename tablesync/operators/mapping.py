"""Declarative record mapping: one `select` compiled from a MappingSpec.

Every row may carry `_present ARRAY<STRING>`, the fields its record actually had. The
mask is renamed along with the fields, so a later merge can tell "absent" (leave the
target alone) from "null" (write null).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions import render
from tablesync.functions.text import first_non_empty, non_empty
from tablesync.functions.transforms import HIT, Context, apply_transform, combine_name, known_transform, split_name
from tablesync.profiles import A2B, B2A, MappingSpec, profile_of, sides

PRESENT = "_present"
ERRORS = "_errors"

# Which mapped addresses feed `email` on side b.
_EMAIL_ORDER = ("personal_email", "company_email", "preferred_contact_email")


@dataclass
class _Field:
    """A value under construction: its expression, type and when it is present."""

    value: Column
    type_name: str
    present: Column
    derived: bool = False


@dataclass
class _Row:
    fields: dict[str, _Field] = field(default_factory=dict)
    errors: list[Column] = field(default_factory=list)
    hits: dict[str, Column] = field(default_factory=dict)

    def context(self, name: str, conf: Mapping, direction: str) -> Context:
        return Context(
            conf,
            direction,
            {n: f.value for n, f in self.fields.items()},
            {n: f.type_name for n, f in self.fields.items()},
            name,
            self.hits.get(name),
        )

    def put(self, name: str, value: Column, type_name: str, present: Column) -> None:
        self.fields[name] = _Field(value, type_name, present, derived=True)

    def either_present(self, *names: str) -> Column:
        flag = F.lit(False)
        for name in names:
            if name in self.fields:
                flag = flag | self.fields[name].present
        return flag


def strip_internal(df: DataFrame, side: str) -> DataFrame:
    """Drops the bookkeeping fields of a side, also from the presence mask."""
    internal = profile_of(side).drop_cols
    out = df.drop(*internal)
    if PRESENT in df.columns and internal:
        gone = F.array(*[F.lit(c) for c in internal])
        out = out.withColumn(PRESENT, F.array_except(PRESENT, gone))
    return out


def _source_row(df: DataFrame) -> _Row:
    masked = PRESENT in df.columns
    row = _Row()
    for f in df.schema.fields:
        if f.name in (PRESENT, ERRORS):
            continue
        if f.name.startswith(HIT):
            row.hits[f.name[len(HIT):]] = F.col(f.name)
            continue
        present = F.array_contains(PRESENT, f.name) if masked else F.lit(True)
        row.fields[f.name] = _Field(F.col(f.name), f.dataType.typeName(), present)
    return row


def _derive(row: _Row, spec: MappingSpec, direction: str) -> None:
    """Adds the derived values; multi-field rules first, then value by value."""
    rules = spec.derive(direction)
    kinds = {name: conf.get("type") for name, conf in rules.items()}
    to_b = direction == A2B

    if to_b and kinds.get("email") == "email_priority":
        order = [f for f in rules["email"].get("email_priority", ()) if f in row.fields]
        if order:
            best = first_non_empty(*[row.fields[f].value for f in order])
            own = row.fields.get("email")
            best = best if own is None else F.coalesce(best, own.value)
            row.put("email", best, "string", row.either_present("email", *order))
    if kinds.get("name") == "name_combination" and to_b:
        parts = [
            row.fields[f].value if f in row.fields else F.lit(None).cast("string")
            for f in ("first_name", "last_name")
        ]
        row.put("name", combine_name(*parts), "string", F.lit(True))
    elif not to_b and (
        kinds.get("name") == "name_combination"
        or kinds.get("first_name") == "reverse_name_combination"
    ):
        full = row.fields.pop("name", None)
        first, last = split_name(full.value if full else F.lit(None).cast("string"))
        row.put("first_name", first, "string", F.lit(True))
        row.put("last_name", last, "string", F.lit(True))

    for name, conf in rules.items():
        kind = conf.get("type")
        if kind in ("email_priority", "name_combination", "reverse_name_combination"):
            continue
        if not known_transform(kind):
            raise ValueError(f"the rule of {name!r} names an unknown transform {kind!r}")
        into = conf.get("into", name)
        known = row.fields.get(name)
        creates = kind == "default_value" or (
            kind == "date_fallback" and conf.get("fallback_field") in row.fields
        )
        if known is None and not creates:
            continue
        value = known.value if known else F.lit(None).cast("string")
        result = apply_transform(value, row.context(name, conf, direction))
        if kind == "default_value":
            present = F.lit(True)
        elif kind == "date_fallback":
            present = row.either_present(conf["primary_field"], conf["fallback_field"])
        elif kind == "project_lookup" and to_b:
            present = known.present & result.isNotNull()  # not found: the field is left alone
        else:
            present = known.present
        row.put(into, result, _result_type(kind, known, to_b, name in row.hits), present)


def _result_type(kind: str | None, known: _Field | None, to_b: bool, looked_up: bool) -> str:
    if kind in ("boolean", "is_milestone_to_needs_submission", "needs_submission_to_is_milestone"):
        return "boolean" if to_b else "integer"
    if kind == "status_mapping":
        return "boolean" if to_b else "string"
    if kind in ("array_to_uuid_array", "uuid_array_to_array"):
        return "array"
    if kind in ("date_fallback", "date_format_conversion") and known is not None:
        return known.type_name
    if kind == "lookup" and looked_up:
        return "string"
    if known is not None and kind in (None, "array_mapping", "lookup"):
        return known.type_name
    return "string"


def _select_target(row: _Row, spec: MappingSpec, direction: str, compat: bool) -> dict[str, _Field]:
    out: dict[str, _Field] = {}
    for source, target in spec.fields(direction).items():
        src, own = row.fields.get(source), row.fields.get(target)
        takes_own = own is not None and (own.derived or compat)
        if target == "id" and direction == A2B and src is not None:
            key = surrogate_key(spec.a_type, src.value)
            out[target] = _Field(key, "string", src.present)
        elif src is not None:
            if takes_own and (compat or source != target):
                # a value derived for the target wins; a null one leaves the field absent
                out[target] = _Field(own.value, own.type_name, own.present & own.value.isNotNull())
            else:
                out[target] = src
        elif own is not None and not (target == "name" and direction == B2A):
            out[target] = _Field(own.value, own.type_name, own.present & own.value.isNotNull())
    return out


def surrogate_key(entity: str | Column, source_id: Column) -> Column:
    """A stable UUID-shaped key: the same record gets the same key in every replay."""
    name = F.lit(entity) if isinstance(entity, str) else entity
    digest = F.sha2(F.concat_ws("/", name, source_id.cast("string")), 256)
    return F.regexp_replace(
        digest, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"
    )


def _email_rule(out: dict[str, _Field], direction: str) -> None:
    if direction == B2A:
        if "email" in out and "personal_email" not in out:
            out["personal_email"] = out["email"]
        return
    found = [out[f] for f in _EMAIL_ORDER if f in out]
    if found:
        best = first_non_empty(*[f.value for f in found])
        own = out.get("email")
        present = F.lit(False)
        for f in found + ([own] if own else []):
            present = present | f.present
        value = best if own is None else F.coalesce(best, own.value)
        out["email"] = _Field(value, "string", present)


def _finish(out: dict[str, _Field], row: _Row, target_side: str) -> None:
    profile = profile_of(target_side)
    for name, f in out.items():
        if name in render.TIMESTAMP_FIELDS:
            f = _Field(
                render.render_timestamp(f.value, profile.iso_timestamps, f.type_name),
                "string",
                f.present,
            )
        elif name in render.BOOLEAN_FIELDS:
            flag = render.coerce_boolean(f.value, f.type_name)
            if f.type_name == "string":
                bad = flag.isNull() & non_empty(f.value).isNotNull()
                row.errors.append(F.when(bad, F.lit(f"{name}: not a boolean")))
            f = _Field(flag, "boolean", f.present)
        if f.type_name == "string":
            f = _Field(render.null_policy(f.value, profile.empty_is_null), "string", f.present)
        out[name] = f


def compile_mapping(
    df: DataFrame,
    spec: MappingSpec,
    direction: str,
    *,
    compat_precedence: bool = False,
) -> list[Column]:
    """The target columns for the rows of `df`, plus `_present` and `_errors`.

    `compat_precedence` lets a raw source column that happens to carry a target's name
    win over the mapped one; by default only derived values do.
    """
    source_side, target_side = sides(direction)
    row = _source_row(df)
    for name in profile_of(source_side).drop_cols:
        row.fields.pop(name, None)
    _derive(row, spec, direction)
    out = _select_target(row, spec, direction, compat_precedence)
    _email_rule(out, direction)
    _finish(out, row, target_side)
    names = render.snake_case_all(list(out))
    columns = [f.value.alias(n) for n, f in zip(names, out.values())]
    mask = F.array_compact(
        F.array(*[F.when(f.present, F.lit(n)) for n, f in zip(names, out.values())])
        if out
        else F.array().cast("array<string>")
    )
    errors = (
        F.array_compact(F.array(*row.errors))
        if row.errors
        else F.array().cast("array<string>")
    )
    return [*columns, mask.alias(PRESENT), errors.alias(ERRORS)]


def map_records(
    df: DataFrame,
    spec: MappingSpec,
    direction: str,
    *,
    keep: tuple[str, ...] = (),
    compat_precedence: bool = False,
) -> DataFrame:
    """Maps every row to the target's shape; `keep` carries columns through unmapped."""
    kept = [F.col(c).alias(c if c.startswith("_") else f"_{c}") for c in keep]
    visible = df.drop(*[c for c in keep if c.startswith("_") and c != PRESENT])
    return df.select(
        *kept, *compile_mapping(visible, spec, direction, compat_precedence=compat_precedence)
    )


def conform(mapped: DataFrame, target: DataFrame) -> DataFrame:
    """Casts mapped columns to the target's types; a value that cannot be cast is null
    and named in `_errors`."""
    wanted = {f.name: f.dataType for f in target.schema.fields}
    columns, errors = [], []
    for f in mapped.schema.fields:
        if f.name in wanted and f.dataType != wanted[f.name]:
            cast = F.col(f.name).try_cast(wanted[f.name])
            lost = cast.isNull() & F.col(f.name).isNotNull()
            errors.append(F.when(lost, F.lit(f"{f.name}: not a {wanted[f.name].simpleString()}")))
            columns.append(cast.alias(f.name))
        elif f.name != ERRORS:
            columns.append(F.col(f.name))
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return mapped.select(*columns, F.concat(ERRORS, found).alias(ERRORS))


def with_audit(df: DataFrame, now: Column, target_side: str) -> DataFrame:
    """Sets the change stamp, and the creation stamp where it is missing."""
    changed, created = ("updated_at", "created_at") if target_side == "b" else ("modified", "creation")
    pattern = "yyyy-MM-dd'T'HH:mm:ss" if target_side == "b" else "yyyy-MM-dd HH:mm:ss"
    stamp = F.date_format(now, pattern)
    out = df.withColumn(changed, stamp)
    first = F.coalesce(F.col(created), stamp) if created in df.columns else stamp
    return out.withColumn(created, first)


def alias_id(df: DataFrame, direction: str, name_col: str = "name") -> DataFrame:
    """Adds `id` from the name going a2b; a record's own id wins."""
    if direction != A2B:
        return df
    name = F.coalesce(F.col(name_col), F.lit("")) if name_col in df.columns else F.lit("")
    own = [F.col("id")] if "id" in df.columns else []
    return df.withColumn("id", F.coalesce(*own, name))
