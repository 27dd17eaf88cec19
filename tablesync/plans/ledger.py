"""The operation ledger: outcomes, retries, retention, status views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3
RETENTION_DAYS = 7


def plan_retries(ledger: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed operations below the limit go back to pending, the rest are dead letters."""
    failed = F.col("status") == "failed"
    again = failed & (F.col("retry_count") < max_retries)
    return ledger.withColumns(
        {
            "requeued": again,
            "dead_letter": failed & ~again,
            "status": F.when(again, "pending").otherwise(F.col("status")),
            "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        }
    )


def transition(ledger: DataFrame, results: DataFrame, key: str = "op_id") -> DataFrame:
    """Applies results (key, ok, error, at) to operations in processing.

    Completed ones leave the open ledger, failed ones carry message and time; a result
    for an operation that is not in processing changes nothing.
    """
    r = results.select(
        F.col(key).alias("_key"), "ok", F.col("error").alias("_error"), F.col("at").alias("_at")
    )
    hit = F.col("_key").isNotNull() & (F.col("status") == "processing")
    joined = ledger.join(r, ledger[key] == r["_key"], "left")
    failed = hit & ~F.col("ok")
    left = joined.where(~(hit & F.col("ok"))).withColumns(
        {
            "error": F.when(failed, F.col("_error")).otherwise(F.col("error")),
            "failed_at": F.when(failed, F.col("_at")),
            "status": F.when(failed, "failed").otherwise(F.col("status")),
        }
    )
    return left.drop("_key", "ok", "_error", "_at")


def queue_status(ledger: DataFrame) -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return ledger.agg(
        n("pending").alias("pending"),
        n("processing").alias("processing"),
        n("failed").alias("failed"),
        (n("pending") + n("processing") + n("failed")).alias("total"),
    )


def lookup(ledger: DataFrame, op_id: str) -> DataFrame:
    return ledger.where(F.col("op_id") == op_id)


def failed_operations(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """Newest failures first: a top-k per task, then a top-k of those."""
    newest = [F.col("created_at").desc(), F.col("op_id").desc()]
    return ledger.where("status = 'failed'").orderBy(*newest).limit(limit)


def retain(ledger: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Drops completed operations older than the retention; open ones always stay."""
    old = (F.col("status") == "completed") & (
        F.col("completed_at") < now - F.make_dt_interval(F.lit(days))
    )
    return ledger.where(~F.coalesce(old, F.lit(False)))
