"""Filtered reads and keyed writes over record tables."""

from __future__ import annotations

from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.text import like_escape
from tablesync.operators.mapping import PRESENT

_OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "like": lambda c, v: c.like(v),
}

Filters = Mapping[str, Any] | Sequence[Sequence[Any]] | None


def predicate(filters: Filters) -> Column:
    """Equalities `{field: value}` or triples `[field, op, value]`, all of which must hold.

    A filter that cannot be understood is an error: dropping it would return rows that
    were asked to be left out.
    """
    if not filters:
        return F.lit(True)
    if isinstance(filters, Mapping):
        triples = [(f, "=", v) for f, v in filters.items()]
    else:
        triples = [tuple(t) for t in filters]
    terms = []
    for triple in triples:
        if len(triple) != 3 or triple[1] not in _OPERATORS:
            raise ValueError(f"not a filter: {triple!r}")
        name, op, value = triple
        terms.append(_OPERATORS[op](F.col(name), value))
    return reduce(lambda a, b: a & b, terms)


def scan(
    table: DataFrame,
    filters: Filters = None,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    order_by: Sequence[Column | str] = (),
) -> DataFrame:
    """Filter and projection reach the file scan; a limit needs an order to be repeatable."""
    out = table.where(predicate(filters))
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def point_read(table: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of many ids at once; `found` is false for an id without a row."""
    hit = table.withColumn("found", F.lit(True))
    return ids.join(hit, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_by(table: DataFrame, key: Column, id_col: str, payload: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest id per key: `_match`, `_target_id`, payload.

    An aggregate, not a window: combined before the shuffle, so a key shared by a third
    of the table costs one partial row per task.
    """
    row = F.struct(F.col(id_col).alias("_target_id"), *[F.col(p) for p in payload])
    best = table.select(key.alias("_match"), row.alias("_row")).where(F.col("_match").isNotNull())
    return best.groupBy("_match").agg(F.min_by("_row", "_row._target_id").alias("_row")).select(
        "_match", "_row.*"
    )


def lookup_by_field(
    values: DataFrame, value_col: str, table: DataFrame, field: str, id_col: str
) -> DataFrame:
    """Id of the first table row whose `field` equals the value, or null."""
    hits = first_by(table, F.col(field), id_col)
    return values.join(hits, values[value_col] == hits["_match"], "left").drop("_match")


def search(table: DataFrame, column: str, term: str) -> DataFrame:
    """Rows containing the term in any case; % and _ in the term are plain characters."""
    return table.where(F.col(column).ilike(f"%{like_escape(term)}%"))


def count_where(table: DataFrame, filters: Filters = None) -> DataFrame:
    return table.where(predicate(filters)).agg(F.count(F.lit(1)).alias("n"))


def latest_per_key(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    columns = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return changes.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert or overwrite by key; fields absent from a change (or its mask) are kept.

    `changes` holds one row per key (see `latest_per_key`, `net_changes`).
    """
    masked = PRESENT in changes.columns
    incoming = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns if c != PRESENT],
                              *([F.col(PRESENT)] if masked else []))
    joined = table.join(incoming, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    has_new = F.col(f"_n_{key}").isNotNull()
    columns = []
    for c in table.columns:
        if c == key:
            columns.append(F.coalesce(F.col(key), F.col(f"_n_{key}")).alias(key))
        elif f"_n_{c}" in joined.columns:
            writes = has_new & F.array_contains(PRESENT, c) if masked else has_new
            columns.append(F.when(writes, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)
