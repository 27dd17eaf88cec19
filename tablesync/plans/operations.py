"""The engine's own operation ledger: attempts as append-only rows, and the state of each
operation as an aggregate over them.

A batch's outcomes become one attempt each (`attempts`). What failed is put back in by
`reinjected`: the events of failed operations that may be tried again, for the next batch.
`operations` has the shape that `plans.ledger` and `plans.metrics` read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.plans.ledger import MAX_RETRIES

# States of an operation, by the status of its outcome.
STATES = {"success": "completed", "error": "failed", "conflict": "conflict", "skipped": "skipped"}


def op_id(event_id: Column, direction: Column) -> Column:
    """One operation per event and direction, whatever the number of attempts."""
    return F.concat(F.lit("op"), F.coalesce(event_id.cast("string"), F.lit("?")), F.lit("/"), F.coalesce(direction, F.lit("-")))


def attempts(ledger: DataFrame, events: DataFrame, at: Column, attempt: int = 1) -> DataFrame:
    """The outcomes of a batch (see `sync_batch`) over `events` as attempts that ended `at`.

    `created_at` is the event's time, that of the earliest of its deliveries; an event without
    an id has none. `duration` are the seconds from there to the end of the attempt.
    Further outcomes of a repeated event are `repeat`s of its operation: they take no attempt.
    """
    created = events.where("event_id is not null").groupBy("event_id").agg(F.min("us").alias("_us"))
    state = F.create_map(*[F.lit(v) for pair in STATES.items() for v in pair])[F.col("status")]
    seconds = (F.unix_micros(at) - F.col("_us")) / 1e6
    return ledger.join(created, "event_id", "left").select(
        op_id(F.col("event_id"), F.col("direction")).alias("op_id"),
        "event_id", "source", "entity", "record_id", "direction", "operation", "target_id",
        state.alias("status"), "reason", F.when(F.col("status") == "error", F.col("reason")).alias("error"),
        F.lit(attempt).alias("attempt"), F.timestamp_micros("_us").alias("created_at"),
        at.alias("updated_at"), seconds.alias("duration"),
    )


_RANK = {"skipped": 0, "failed": 1, "conflict": 2, "completed": 3}


def operations(log: DataFrame) -> DataFrame:
    """The latest state of each operation. Of several outcomes of one attempt (deliveries of one
    event) the most telling counts: completed, conflict, failed, then skipped. One partial
    aggregate: an operation with any number of attempts is as cheap as another."""
    rank = F.create_map(*[F.lit(v) for pair in _RANK.items() for v in pair])[F.col("status")]
    state = [c for c in log.columns if c not in ("op_id", "attempt", "created_at")]
    last = F.max_by(F.struct(*state), F.struct("attempt", rank, F.coalesce("reason", F.lit(""))))
    done = F.col("status") == "completed"
    return (
        log.groupBy("op_id")
        .agg(last.alias("_s"), (F.max("attempt") - 1).alias("retry_count"), F.min("created_at").alias("created_at"))
        .select("op_id", "_s.*", "retry_count", "created_at")
        .withColumn("completed_at", F.when(done, F.col("updated_at")))
    )


def reinjected(events: DataFrame, ops: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The events of failed operations that may be tried again: the next batch's input."""
    again = ops.where((F.col("status") == "failed") & (F.col("retry_count") < max_retries))
    return events.join(again.select("event_id").distinct(), "event_id", "left_semi")
