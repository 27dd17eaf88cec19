"""Field catalogs: from landed metadata, from table contents, from JSON payloads."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.text import field_label

VARCHAR_LIMIT = 255

# Column type of side b for each field type of side a.
A_TO_B_TYPE = {
    "Data": "text",
    "Int": "integer",
    "Float": "numeric",
    "Check": "boolean",
    "Date": "date",
    "Datetime": "timestamp",
    "Time": "time",
    "Text": "text",
    "Small Text": "text",
    "Long Text": "text",
    "Code": "text",
    "Link": "text",
    "Dynamic Link": "text",
    "Select": "text",
    "Read Only": "text",
    "Password": "text",
    "Attach": "text",
    "Attach Image": "text",
    "Signature": "text",
    "Color": "text",
    "Barcode": "text",
    "Geolocation": "text",
    "Duration": "integer",
    "Currency": "numeric",
    "Percent": "numeric",
}
# Types of side b that a field type of side a can be kept in.
COMPATIBLE_TYPES = {
    "Data": ("varchar", "text"),
    "Int": ("integer", "bigint"),
    "Float": ("numeric", "real", "double precision"),
    "Check": ("boolean",),
    "Date": ("date",),
    "Datetime": ("timestamp", "timestamptz"),
    "Time": ("time",),
    "Text": ("text", "varchar"),
    "Long Text": ("text",),
    "Code": ("text", "varchar"),
    "Link": ("text", "varchar"),
    "Select": ("text", "varchar"),
    "Currency": ("numeric", "money"),
    "Percent": ("numeric",),
}
SPARK_TYPE_OF_B = {
    "text": "string",
    "integer": "bigint",
    "numeric": "decimal(38,9)",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "time": "string",
}

METADATA_SCHEMA = (
    "array<struct<fieldname string, label string, fieldtype string, options string, reqd int, "
    "read_only int, hidden int, description string, default string, length int, precision int>>"
)


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def translate_type(a_type: Column) -> Column:
    return F.try_element_at(_literal_map(A_TO_B_TYPE), a_type)


def spark_type(b_type: Column) -> Column:
    return F.try_element_at(_literal_map(SPARK_TYPE_OF_B), b_type)


def type_score(a_type: Column, b_type: Column) -> Column:
    """1 for a compatible type, .8 if one is part of the type's name, else 0."""
    table = F.create_map(
        *[
            x
            for name, kinds in COMPATIBLE_TYPES.items()
            for x in (F.lit(name), F.array(*[F.lit(k) for k in kinds]))
        ]
    )
    fits = F.try_element_at(table, a_type)
    part = F.exists(fits, lambda kind: F.contains(b_type, kind))
    return (
        F.when(F.coalesce(F.array_contains(fits, b_type), F.lit(False)), 1.0)
        .when((b_type != "") & F.coalesce(part, F.lit(False)), 0.8)
        .otherwise(0.0)
    )


def catalog_from_metadata(
    metadata: DataFrame,
    table: str = "table",
    fields_json: str = "fields",
    skip: Sequence[str] = (),
) -> DataFrame:
    """One row per field of landed metadata (JSON array of field descriptions)."""
    flat = metadata.select(
        F.col(table).alias("table"),
        F.posexplode(F.from_json(fields_json, METADATA_SCHEMA)).alias("ordinal", "f"),
    )
    kept = flat.where(~F.coalesce(F.col("f.fieldname").isin(*skip), F.lit(False))) if skip else flat
    return kept.select(
        "table",
        "ordinal",
        "f.fieldname",
        "f.label",
        "f.fieldtype",
        "f.options",
        *[F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in ("reqd", "read_only", "hidden")],
        F.coalesce("f.description", F.lit("")).alias("description"),
        "f.default",
        "f.length",
        "f.precision",
    )


def _declared_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "jsonb"
    return "varchar"


def profile(table: DataFrame, name: str) -> DataFrame:
    """Per column: type, rows, nulls, longest text. One aggregate over the whole table."""
    fields = table.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count(F.col(f.name)).alias(f"_n{i}"))
        text = F.length(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("int")
        aggs.append(F.max(text).alias(f"_l{i}"))
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("fieldname"),
                F.lit(_declared_type(f.dataType)).alias("declared"),
                F.col("_rows").alias("n_rows"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("n_null"),
                F.col(f"_l{i}").alias("max_length"),
            )
            for i, f in enumerate(fields)
        ]
    )
    rows = table.agg(*aggs).select(F.explode(lines).alias("r")).select("r.*")
    kind = F.when(
        (F.col("declared") == "varchar")
        & ((F.col("n_null") == F.col("n_rows")) | (F.col("max_length") > VARCHAR_LIMIT)),
        "text",
    ).otherwise(F.col("declared"))
    return rows.select(
        F.lit(name).alias("table"),
        "ordinal",
        "fieldname",
        kind.alias("fieldtype"),
        "n_rows",
        "n_null",
        "max_length",
    )


def catalog_from_table(table: DataFrame, name: str, skip: Sequence[str] = ()) -> DataFrame:
    """Field catalog of a table from its whole contents; labels come from the names."""
    kept = table.select(*[c for c in table.columns if c not in skip])
    return profile(kept, name).select(
        "table",
        "ordinal",
        "fieldname",
        field_label(F.col("fieldname")).alias("label"),
        "fieldtype",
        (F.col("n_null") > 0).alias("nullable"),
    )


def catalog_from_json(records: DataFrame, payload: str, table: Column) -> DataFrame:
    """Field catalog of JSON records, over all of them: the widest type seen wins.

    Partial aggregation per (table, field); no sample and no first-row guess.
    """
    values = records.select(
        table.alias("table"), F.try_parse_json(payload).alias("_v")
    ).lateralJoin(
        records.sparkSession.tvf.variant_explode(F.col("_v").outer())
    ).select("table", F.col("key").alias("fieldname"), "value")
    kind = F.schema_of_variant("value")
    is_text, is_number = kind == "STRING", kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    nested = kind.rlike("^(OBJECT|ARRAY)")
    length = F.length(F.try_variant_get("value", "$", "string"))
    found = values.groupBy("table", "fieldname").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(kind == "VOID").alias("n_null"),
        F.max(F.when(is_text, length)).alias("max_length"),
        F.bool_or(nested).alias("_nested"),
        F.bool_or(is_number).alias("_number"),
        F.bool_or(kind == "BIGINT").alias("_integer"),
        F.bool_or(kind == "BOOLEAN").alias("_boolean"),
    )
    fieldtype = (
        F.when(F.col("_nested"), "jsonb")
        .when(F.col("max_length") > VARCHAR_LIMIT, "text")
        .when(F.col("max_length").isNotNull(), "varchar")
        .when(F.col("_number"), "numeric")
        .when(F.col("_integer"), "integer")
        .when(F.col("_boolean"), "boolean")
        .otherwise("text")
    )
    return found.select(
        "table",
        "fieldname",
        field_label(F.col("fieldname")).alias("label"),
        fieldtype.alias("fieldtype"),
        "n_rows",
        "n_null",
        "max_length",
    )


def event_related(tables: DataFrame, column: str = "table") -> DataFrame:
    """Tables whose name speaks of events or trainings, in any case."""
    name = F.lower(column)
    return tables.where(name.contains("event") | name.contains("training"))


def schema_summary(catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    """Tables and field counts: one row per table, per side (table null) and in total.

    Names come as rows, not as one list, so a side may hold any number of tables.
    """
    both = catalog_a.select(F.lit("a").alias("side"), "table").unionByName(
        catalog_b.select(F.lit("b").alias("side"), "table")
    )
    per_table = both.groupBy("side", "table").agg(F.count(F.lit(1)).alias("n"))
    return per_table.rollup("side", "table").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("n").alias("n_fields")
    )
