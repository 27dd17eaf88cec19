"""Record matching: one equi join per batch instead of one request per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.functions.identity import normalize_phone
from tablesync.functions.text import non_empty, snippet
from tablesync.operators.scan import first_by
from tablesync.profiles import MappingSpec, MatchKey


def match_values(df: DataFrame, spec: MappingSpec, direction: str) -> list[Column]:
    """Value of each match key, null where an earlier key of the row is usable."""
    values = [_key_value(df, key, direction) for key in spec.match_keys]
    return [
        F.when(F.coalesce(*values[:n]).isNull(), v) if n else v for n, v in enumerate(values)
    ]


def _key_value(df: DataFrame, key: MatchKey, direction: str) -> Column:
    column = key.column(direction)
    if column not in df.columns:
        return F.lit(None).cast("string")
    value = F.col(column).cast("string")
    return normalize_phone(value) if key.kind == "phone" else non_empty(value)


def find_targets(
    mapped: DataFrame,
    target: DataFrame,
    spec: MappingSpec,
    direction: str,
    id_col: str,
    payload: tuple[str, ...] = (),
    salt: str | None = None,
) -> DataFrame:
    """Adds `match_kind`, `match_value`, `target_id` and payload (as `t_<name>`).

    Each kind of key is one equi left join against the target, cut to the keys that the batch
    has and reduced to one row per key, that with the smallest id. Where the key is a
    subject, the mapped text's snippet must also occur in the text of the target: all rows
    of the subject are tested, and the smallest id of those that fit is the one. If none does, the record
    counts as not found. `found_id` is the smallest id before that test: deletes go by
    the key alone.
    """
    out = mapped
    for n, value in enumerate(match_values(mapped, spec, direction)):
        out = out.withColumn(f"_v{n}", value)
    found: list[Column] = []
    unverified: list[Column] = []
    carried: dict[str, list[Column]] = {p: [] for p in payload}
    for n, key in enumerate(spec.match_keys):
        column, text = key.column(direction), key.text(direction)
        extra = tuple(dict.fromkeys([*payload, *([text] if text else [])]))
        known = asked_for(target, _key_value(target, key, direction), out.select(F.col(f"_v{n}").alias("_match")))
        side = first_by(known, F.col("_match"), id_col, extra).select(
            F.col("_match").alias(f"_m{n}"), F.struct("_target_id", *extra).alias(f"_t{n}")
        )
        own = F.col(f"_v{n}")
        if salt:  # rows without a key would all meet in one partition
            own = F.coalesce(own, F.concat(F.lit("\u0000"), F.col(salt).cast("string")))
        checks = bool(text) and text in mapped.columns
        pieces = out.select(f"_v{n}", snippet(F.col(text)).alias("_piece")) if checks else None
        out = out.join(side, own == F.col(f"_m{n}"), "left")
        first = F.when(F.col(f"_m{n}").isNotNull(), F.col(f"_t{n}"))
        unverified.append(first["_target_id"])
        if checks:
            fits = fitting(known, pieces, f"_v{n}", text, id_col, extra).withColumnsRenamed(
                {f"_v{n}": f"_w{n}", "_piece": f"_p{n}", "_fit": f"_f{n}"}
            )
            piece = snippet(F.col(text))
            out = out.join(fits, (own == F.col(f"_w{n}")) & (piece == F.col(f"_p{n}")), "left")
            first = F.when(piece == "", first).otherwise(F.col(f"_f{n}"))
        found.append(first["_target_id"])
        for p in payload:
            carried[p].append(first[p])
    none = F.lit(None).cast("string")
    ks = range(len(spec.match_keys))
    kind = [F.when(F.col(f"_v{n}").isNotNull(), k.kind) for n, k in enumerate(spec.match_keys)]
    out = out.withColumn("match_kind", F.coalesce(*kind) if kind else none)
    out = out.withColumn("match_value", F.coalesce(*[F.col(f"_v{n}") for n in ks]) if kind else none)
    out = out.withColumn("target_id", F.coalesce(*found) if found else none)
    out = out.withColumn("found_id", F.coalesce(*unverified) if found else none)
    for p, options in carried.items():
        out = out.withColumn(f"t_{p}", F.coalesce(*options) if options else F.lit(None).cast(target.schema[p].dataType))
    return out.drop(*[f"_{x}{n}" for n in ks for x in "vmtwpf"])


def asked_for(target: DataFrame, key: Column, asked: DataFrame) -> DataFrame:
    """The target's rows whose key (`_match`) the batch asks for: what is moved from here on
    grows with the batch, not with the table."""
    wanted = asked.where(F.col("_match").isNotNull()).distinct()
    return target.withColumn("_match", key).join(wanted, "_match", "left_semi")


def fitting(
    known: DataFrame, pieces: DataFrame, key: str, text: str, id_col: str, extra: tuple[str, ...]
) -> DataFrame:
    """(key, _piece, _fit): of each key and piece of text, the row with the smallest id among the
    key's rows whose text holds the piece.

    Equal texts of a key and equal pieces meet once each, however many rows have them; the
    pairs of a hot key are split by adaptive execution and combined by a partial minimum.
    """
    row = F.struct(F.col(id_col).alias("_target_id"), *extra)
    texts = known.groupBy("_match", F.coalesce(text, F.lit("")).alias("_text")).agg(
        F.min_by(row, F.col(id_col)).alias("_row")
    )
    asked = pieces.where((F.col("_piece") != "") & F.col(key).isNotNull()).distinct()
    return (
        asked.join(texts, F.col(key) == F.col("_match"))
        .where(F.col("_text").contains(F.col("_piece")))
        .groupBy(key, "_piece")
        .agg(F.min_by("_row", F.col("_row._target_id")).alias("_fit"))
    )


def resolve_operation(
    events: DataFrame,
    *,
    key: str = "match_value",
    exists: Column | None = None,
    micros: str = "us",
    id_col: str = "event_id",
    operation: str = "operation",
    slice_us: int = 3_600_000_000,
) -> DataFrame:
    """Adds `was_there` and `resolved`: delete stays; update if the record exists by
    then, else create.

    A record exists if the target had it before the batch and the batch did not delete
    it, or if the batch's previous operation on the same key wrote it. That needs only
    the row before, taken per (key, time slice) so that a hot key spreads out; the last
    operation of earlier slices comes from one small row per slice.
    """
    exists = F.col("target_id").isNotNull() if exists is None else exists
    # a record without a key is nobody's successor: it gets a group of its own
    own_key = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))
    keyed = events.withColumn("_key", own_key).withColumn(
        "_part", F.expr(f"({micros} - pmod({micros}, {slice_us}L)) div {slice_us}L")
    )
    order = [F.col(micros), F.col(id_col)]
    per_part = (
        keyed.where(F.col(key).isNotNull())
        .groupBy("_key", "_part")
        .agg(F.max_by(operation, F.struct(*order)).alias("_last"))
    )
    handed = per_part.select(
        F.col("_key").alias("_who"),
        F.col("_part").alias("_at"),
        F.lag("_last").over(W.partitionBy("_key").orderBy("_part")).alias("_earlier"),
    ).where("_earlier is not null")
    rows = keyed.withColumn(
        "_before", F.lag(operation).over(W.partitionBy("_key", "_part").orderBy(*order))
    ).join(handed, (F.col("_key") == F.col("_who")) & (F.col("_part") == F.col("_at")), "left")
    before = F.coalesce("_before", "_earlier")
    is_there = F.when(before.isNull(), exists).otherwise(before != "delete")
    known = rows.withColumn("was_there", is_there).drop(
        "_key", "_part", "_before", "_earlier", "_who", "_at"
    )
    resolved = (
        F.when(F.col(operation) == "delete", "delete")
        .when(F.col("was_there"), "update")
        .otherwise("create")
    )
    return known.withColumn("resolved", resolved)


def reconcile(
    left: DataFrame,
    left_key: Column,
    left_id: str,
    right: DataFrame,
    right_key: Column,
    right_id: str,
) -> DataFrame:
    """Linkage table of two whole tables: matched / only_a / only_b per identity."""
    a = first_by(left, left_key, left_id).select("_match", F.col("_target_id").alias("a_id"))
    b = first_by(right, right_key, right_id).select("_match", F.col("_target_id").alias("b_id"))
    state = (
        F.when(F.col("b_id").isNull(), "only_a").when(F.col("a_id").isNull(), "only_b")
        .otherwise("matched")
    )
    return a.join(b, "_match", "full_outer").select(
        F.col("_match").alias("identity"), "a_id", "b_id", state.alias("state")
    )


def identity_collisions(table: DataFrame, identity: Column, id_col: str) -> DataFrame:
    """Identities shared by several records: how many, and the first and last of them."""
    return (
        table.select(identity.alias("identity"), F.col(id_col).alias("_id"))
        .where(F.col("identity").isNotNull())
        .groupBy("identity")
        .agg(
            F.count(F.lit(1)).alias("n_records"),
            F.min("_id").alias("first_id"),
            F.max("_id").alias("last_id"),
        )
        .where("n_records > 1")
    )
