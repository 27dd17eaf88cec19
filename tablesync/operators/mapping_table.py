"""Mapping configurations as a table: validation, upsert, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required keys and container checks per caller of the validation.
PROFILES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "mapper": (("a_type", "b_table", "field_mappings"), {"field_mappings": "{"}),
    "engine": (("a_type", "b_table", "field_mappings", "reverse_mappings"), {}),
    "service": (("a_type", "b_table", "sync_fields"), {}),
    "api": (
        ("a_type", "b_table", "field_mappings"),
        {"field_mappings": "{", "sync_fields": "["},
    ),
}
_VARIANT = {"{": "OBJECT", "[": "ARRAY"}
_CONTAINER = {"{": "must be a dictionary", "[": "must be a list"}


def validation_errors(conf: Column, profile: str = "mapper") -> Column:
    """Error list of a mapping configuration in JSON; a key with a null value counts."""
    required, containers = PROFILES[profile]
    keys = F.coalesce(F.json_object_keys(conf), F.array().cast("array<string>"))
    checks = [
        F.when(~F.array_contains(keys, name), F.lit(f"Missing required field: {name}"))
        for name in required
    ]
    for name, opening in containers.items():
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(conf), f"$.{name}", "variant"))
        right = F.coalesce(kind.startswith(_VARIANT[opening]), F.lit(False))
        wrong = F.array_contains(keys, name) & ~right
        checks.append(F.when(wrong, F.lit(f"{name} {_CONTAINER[opening]}")))
    return F.array_compact(F.array(*checks))


def upsert_mappings(mappings: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """Whole entries are replaced by key, others stay."""
    kept = mappings.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(*mappings.columns))


def remove_mappings(mappings: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    return mappings.join(names.select(key).distinct(), key, "left_anti")


def removal_report(mappings: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """deleted / not_found per requested name."""
    known = mappings.select(key).distinct().withColumn("_hit", F.lit(True))
    return names.select(key).distinct().join(known, key, "left").select(
        key, F.when(F.col("_hit"), "deleted").otherwise("not_found").alias("outcome")
    )
