"""Last-step rendering of mapped values: time stamps, booleans, nulls, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesync.functions.text import word_to_boolean

# The only fields these rules apply to.
TIMESTAMP_FIELDS = ("created_at", "updated_at", "creation", "modified")
BOOLEAN_FIELDS = ("disabled", "enabled", "active", "inactive", "verified")

_STAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.(?!0{6})\d{6})?$"
_CLOCK_END = r"(?=[Z+.,-]|$)"


def render_timestamp(value: Column, iso: bool, type_name: str = "string") -> Column:
    """Wall-clock text of a stamp: ISO for side b, 'yyyy-MM-dd HH:mm:ss' for side a.

    An offset is carried along (b) or dropped (a), never converted; text that is not a
    valid stamp stays as it is.
    """
    if type_name != "string":
        pattern = "yyyy-MM-dd'T'HH:mm:ss" if iso else "yyyy-MM-dd HH:mm:ss"
        whole = F.date_format(value, pattern)
        if not iso:
            return whole
        micros = F.date_format(value, "SSSSSS")
        return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))

    # the usual shape needs no rewriting but its separator
    plain = value.rlike(_PLAIN) & to_utc(value).isNotNull()
    clock = F.substring(value, 12, 15 if iso else 8)
    parts = [F.substring(value, 1, 10), F.lit("T" if iso else " "), clock]
    # each step rewrites the one before, so the value is named only once
    text = F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    text = F.regexp_replace(text, r"^(.{10})[T ](\d{2}:\d{2})" + _CLOCK_END, "$1T$2:00")
    if iso:
        text = F.regexp_replace(text, "^(.{10}) ", "$1T")
        text = F.regexp_replace(text, r"[.,](\d+)", ".$1000000")
        text = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
        text = F.regexp_replace(text, r"\.000000", "")
        text = F.regexp_replace(text, "Z$", "+00:00")
    else:
        text = F.regexp_replace(F.substring(text, 1, 19), "T", " ")
    return (
        F.when(plain, F.concat(*parts))
        .when(value.rlike(_STAMP) & to_utc(value).isNotNull(), text)
        .otherwise(value)
    )


def to_utc(value: Column) -> Column:
    """A stamp of either side as an instant; text without an offset is UTC."""
    return F.try_to_timestamp(value)


def coerce_boolean(value: Column, type_name: str = "string") -> Column:
    """Known words as booleans, numbers by non-zero; unknown text is null here and is
    reported by the caller's `_errors`."""
    if type_name == "boolean":
        return value
    return word_to_boolean(value) if type_name == "string" else value != 0


def null_policy(value: Column, empty_is_null: bool) -> Column:
    """Side b stores null for '', side a stores '' for null. For text columns."""
    return F.nullif(value, F.lit("")) if empty_is_null else F.coalesce(value, F.lit(""))


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def snake_case_all(names: list[str]) -> list[str]:
    """Renamed columns; two that would fall together are an error, not a silent loss."""
    renamed = [snake_case(n) for n in names]
    clashes = sorted({n for n in renamed if renamed.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after renaming: {clashes}")
    return renamed
