"""Value transforms, by type name: `fn(value, ctx) -> Column`.

Every transform is a null-safe Column expression, so a bad value in one field never
touches the other fields of its row. `register_transform` adds new types.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.text import first_non_empty, non_empty, strip, word_to_boolean
from tablesync.profiles import A2B


@dataclass(frozen=True)
class Context:
    """What a transform may look at besides its own value."""

    conf: Mapping[str, Any]
    direction: str
    row: Mapping[str, Column] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)  # field -> simple type name
    name: str = ""
    hit: Column | None = None  # what a lookup in front of the mapping found

    @property
    def to_b(self) -> bool:
        return self.direction == A2B


Transform = Callable[[Column, Context], Column]
HIT = "_hit_"  # columns with what lookups found, by field
_REGISTRY: dict[str, Transform] = {}


def register_transform(name: str, fn: Transform) -> None:
    _REGISTRY[name] = fn


def _named(*names: str):
    def keep(fn: Transform) -> Transform:
        for name in names:
            register_transform(name, fn)
        return fn

    return keep


def apply_transform(value: Column, ctx: Context) -> Column:
    """The transform of `ctx.conf['type']`; an unknown type leaves the value as it is. Mappings
    that name one are refused when they are compiled (`known_transform`)."""
    fn = _REGISTRY.get(ctx.conf.get("type", ""))
    return value if fn is None else fn(value, ctx)


def known_transform(kind: str | None) -> bool:
    return not kind or kind in _REGISTRY


# --- names -------------------------------------------------------------------------


def combine_name(first: Column, last: Column) -> Column:
    """'first last' with the missing part left out."""
    return strip(F.concat_ws(" ", non_empty(first), non_empty(last)))


def split_name(full: Column) -> tuple[Column, Column]:
    """(first, last), cut at the first blank; a missing part is ''."""
    parts = F.split(full, " ", 2)
    return (
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")),
    )


# --- booleans and codes ------------------------------------------------------------


def truth(value: Column, type_name: str = "string") -> Column:
    """Truth of a value: missing, empty, zero and the 'false' words are false."""
    if type_name == "boolean":
        return F.coalesce(value, F.lit(False))
    if type_name == "string":
        return F.coalesce(word_to_boolean(value), value != "", F.lit(False))
    return F.coalesce(value != 0, F.lit(False))


@_named("boolean", "is_milestone_to_needs_submission", "needs_submission_to_is_milestone")
def _boolean(value: Column, ctx: Context) -> Column:
    kind = ctx.types.get(ctx.name, "string")
    plain = not ctx.to_b or ctx.conf["type"] == "is_milestone_to_needs_submission"
    if kind == "string" and plain:
        flag = F.coalesce(value != "", F.lit(False))
    else:
        flag = truth(value, kind)
    return flag if ctx.to_b else flag.cast("int")


@_named("status_mapping")
def _status(value: Column, ctx: Context) -> Column:
    active = ctx.conf.get("active_status", "Active")
    inactive = ctx.conf.get("inactive_status", "Inactive")
    if ctx.to_b:
        return F.coalesce(value == active, F.lit(False))
    kind = ctx.types.get(ctx.name, "boolean")
    is_active = F.coalesce(value != "", F.lit(False)) if kind == "string" else truth(value, kind)
    return F.when(is_active, active).otherwise(inactive)


@_named("company_to_org_mapping", "value_map")
def _value_map(value: Column, ctx: Context) -> Column:
    return map_values(value, ctx.conf.get("mappings", {}))


def map_values(value: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped value, or the value itself when the map has none."""
    if not mapping:
        return value
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


# --- identifiers -------------------------------------------------------------------


def decode_project(value: Column) -> Column:
    """PROJ-0001 -> '1', PROJ-x and empty -> null, other text stays."""
    number = F.get(F.split(value, "-"), F.lit(1)).try_cast("bigint").cast("string")
    return F.when(value.startswith("PROJ-"), number).otherwise(non_empty(value))


def encode_number(number: Column, prefix: str, width: int) -> Column:
    """Zero-padded to `width`, longer numbers are kept whole."""
    return F.when(
        number.isNotNull(), F.format_string(f"{prefix}%0{width}d", number.cast("bigint"))
    )


@_named("string_to_int")
def _string_to_int(value: Column, ctx: Context) -> Column:
    if ctx.to_b:
        return decode_project(value)
    if ctx.types.get(ctx.name, "string") == "string":
        return non_empty(value)
    return F.when(value != 0, encode_number(value, "PROJ-", 4))


def decode_project_id(value: Column, by_name: Column | None = None) -> Column:
    """PROJ-001 -> '1'; an unreadable number falls back to a name lookup, then the text."""
    rest = F.replace(value, F.lit("PROJ-"), F.lit(""))
    number = rest.try_cast("bigint").cast("string")
    fallback = value if by_name is None else F.coalesce(by_name, value)
    return F.when(value.startswith("PROJ-"), F.coalesce(number, fallback)).otherwise(value)


def encode_project_id(value: Column) -> Column:
    number = value.try_cast("bigint")
    return F.coalesce(encode_number(number, "PROJ-", 3), value.cast("string"))


def decode_task_id(value: Column) -> Column:
    """TASK-<year>-<n> -> the third part as a number, else the text."""
    number = F.get(F.split(value, "-"), F.lit(2)).try_cast("bigint").cast("string")
    return F.when(value.startswith("TASK-"), F.coalesce(number, value)).otherwise(value)


def encode_task_id(value: Column, year: int) -> Column:
    number = value.try_cast("bigint")
    return F.coalesce(encode_number(number, f"TASK-{year}-", 4), value.cast("string"))


@_named("task_project")
def _task_project(value: Column, ctx: Context) -> Column:
    return decode_project_id(value, ctx.hit) if ctx.to_b else encode_project_id(value)


@_named("lookup")
def _lookup(value: Column, ctx: Context) -> Column:
    return value if ctx.hit is None else F.coalesce(ctx.hit, value.cast("string"))


@_named("project_lookup")
def _project_lookup(value: Column, ctx: Context) -> Column:
    """Going a2b a project that is not found is null; coming back it stays as it is."""
    if ctx.hit is None:
        return non_empty(value.cast("string"))
    return ctx.hit if ctx.to_b else F.coalesce(ctx.hit, non_empty(value.cast("string")))


@_named("array_mapping")
def _kept(value: Column, ctx: Context) -> Column:
    return value


@_named("task_id")
def _task_id(value: Column, ctx: Context) -> Column:
    return decode_task_id(value) if ctx.to_b else encode_task_id(value, int(ctx.conf["year"]))


@_named("prefix_transform")
def _prefix(value: Column, ctx: Context) -> Column:
    prefix = ctx.conf.get("prefix", "")
    if ctx.to_b:
        rest = F.replace(value, F.lit(prefix), F.lit("")) if prefix else value
        digits = F.replace(rest, F.lit("-"), F.lit(""))
        number = digits.try_cast("bigint").cast("string")
        return F.when(value.startswith(prefix), F.coalesce(number, value)).otherwise(value)
    number = value.try_cast("bigint")
    padded = encode_number(number, f"{prefix}-{int(ctx.conf['year'])}-", 4)
    return F.coalesce(padded, value.cast("string"))


# --- dates, defaults, arrays -------------------------------------------------------


@_named("date_fallback")
def _date_fallback(value: Column, ctx: Context) -> Column:
    names = (ctx.conf.get("primary_field"), ctx.conf.get("fallback_field"))
    if not all(names):
        return value
    found = [ctx.row[n] for n in names if n in ctx.row]
    return F.coalesce(*found, value) if found else value


@_named("default_value")
def _default_value(value: Column, ctx: Context) -> Column:
    constant = ctx.conf.get("value")
    if constant is None:
        return value
    if ctx.conf.get("mode", "overwrite") == "if_absent":
        return F.coalesce(value, F.lit(constant))
    return F.lit(constant)


@_named("date_format_conversion")
def _iso_to_date(value: Column, ctx: Context) -> Column:
    if (ctx.conf.get("input_format"), ctx.conf.get("output_format")) != (
        "iso_datetime",
        "date_string",
    ):
        return value
    return F.substring_index(value, "T", 1)


@_named("array_to_uuid_array", "uuid_array_to_array")
def _array(value: Column, ctx: Context) -> Column:
    if ctx.hit is not None:
        own = value.cast("array<string>") if ctx.types.get(ctx.name, "string") != "string" else parse_array(value)
        return F.coalesce(ctx.hit, own)
    return value if ctx.types.get(ctx.name, "string") != "string" else parse_array(value)


def parse_array(text: Column) -> Column:
    """Text literal of a list, with either kind of quote, as an array; null if malformed."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


@_named("email_priority")
def _email_priority(value: Column, ctx: Context) -> Column:
    if not ctx.to_b:
        return value
    found = [ctx.row[f] for f in ctx.conf.get("email_priority", ()) if f in ctx.row]
    return first_non_empty(*found) if found else value


# --- lookups: one equi join instead of a request per record --------------------------


def unique_by(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row per key, by the smallest values: a plain aggregate, combined map-side."""
    packed = F.min(F.struct(*[F.col(v) for v in values]))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_first"))
    return picked.select(key, *[F.col(f"_first.{v}").alias(v) for v in values])


def lookup(
    df: DataFrame,
    column: str,
    dim: DataFrame,
    dim_key: str,
    dim_value: str,
    *,
    output: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Replaces `column` by the dimension's value; a miss keeps the value, or is null if strict.

    No broadcast hint: Spark broadcasts the dimension only when its measured size
    allows, and splits a hot key of the large side otherwise.
    """
    side = unique_by(dim, dim_key, dim_value).select(
        F.col(dim_key).alias("_key"), F.col(dim_value).cast("string").alias("_hit")
    )
    joined = df.join(side, df[column] == side["_key"], "left")
    value = F.col("_hit") if strict else F.coalesce("_hit", F.col(column).cast("string"))
    return joined.withColumn(output or column, value).drop("_key", "_hit")


def lookup_elements(
    df: DataFrame,
    row_id: str,
    column: str,
    dim: DataFrame,
    dim_key: str,
    dim_value: str,
) -> DataFrame:
    """Looks up every element of an array column; order and misses are kept.

    Regrouping is by the row id, so a group is one row's own array.
    """
    side = unique_by(dim, dim_key, dim_value).select(
        F.col(dim_key).cast("string").alias("_key"), F.col(dim_value).alias("_hit")
    )
    flat = df.select(row_id, F.posexplode(column).alias("_pos", "_item"))
    hits = flat.join(side, F.col("_item") == F.col("_key"), "left").select(
        row_id, F.struct("_pos", F.coalesce("_hit", "_item").alias("v")).alias("_e")
    )
    arrays = hits.groupBy(row_id).agg(F.sort_array(F.collect_list("_e")).alias("_es"))
    return (
        df.join(arrays, row_id, "left")
        .withColumn(
            column,
            F.when(F.size(column) == 0, F.col(column)).otherwise(
                F.transform("_es", lambda e: e["v"])
            ),
        )
        .drop("_es")
    )


def fan_out(value: Column, fields: Sequence[str]) -> list[Column]:
    return [value.alias(f) for f in fields]
