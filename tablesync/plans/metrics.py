"""Sync metrics as aggregates over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DURATION_SAMPLES = 1000
RECENT = 10
HEALTHY_BELOW = 10


def counts(ledger: DataFrame, *by: str) -> DataFrame:
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def operation_counts(ledger: DataFrame) -> DataFrame:
    return counts(ledger, "operation", "status").select(
        F.concat_ws("_", "operation", "status").alias("metric"), "n"
    )


def error_counts(ledger: DataFrame, error_type: str = "error") -> DataFrame:
    return counts(ledger.where("status = 'failed'"), error_type, "source").select(
        F.concat_ws("_", error_type, "source").alias("metric"), "n"
    )


def conflict_counts(ledger: DataFrame) -> DataFrame:
    return counts(ledger.where("status = 'conflict'"), "entity")


def retry_counts(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where("retry_count > 0")
        .groupBy("op_id")
        .agg(F.sum("retry_count").cast("bigint").alias("n"))
    )


def latest(ledger: DataFrame, n: int) -> DataFrame:
    return ledger.orderBy(F.col("created_at").desc(), F.col("op_id").desc()).limit(n)


def duration_stats(ledger: DataFrame, samples: int = DURATION_SAMPLES) -> DataFrame:
    """Mean and count of the last durations, and the most recent ones in order.

    The sample is a distributed top-k, so only `samples` rows reach the final step.
    """
    last = latest(ledger.select("op_id", "created_at", "duration"), samples)
    place = F.row_number().over(
        W.partitionBy(F.lit(1)).orderBy(F.col("created_at").desc(), F.col("op_id").desc())
    )
    ranked = last.withColumn("_rank", place)
    recent = F.sort_array(
        F.collect_list(F.when(F.col("_rank") <= RECENT, F.struct("_rank", "duration")))
    )
    return ranked.agg(
        F.round(F.avg("duration"), 6).alias("average"),
        F.count(F.lit(1)).alias("samples"),
        F.transform(recent, lambda r: r["duration"]).alias("recent"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Percentage rounded half-even to two digits; 0 for an empty whole."""
    exact = part.cast("double") / whole * 100
    return F.when(whole > 0, F.bround(exact, 2)).otherwise(F.lit(0.0))


def rates(ledger: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return ledger.agg(
        percent(F.count_if(F.col("status") == "completed"), total).alias("success_rate"),
        percent(F.count_if(F.col("status") == "failed"), total).alias("error_rate"),
    )


def summary(ledger: DataFrame) -> DataFrame:
    """All totals and the health class in one pass."""
    total = F.count(F.lit(1))
    failed = F.count_if(F.col("status") == "failed")
    return ledger.agg(
        F.count_distinct("event_id").alias("total_events"),
        total.alias("total_operations"),
        failed.alias("total_errors"),
        F.count_if(F.col("status") == "conflict").alias("total_conflicts"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).cast("bigint").alias("total_retries"),
        percent(failed, total).alias("error_rate"),
    ).withColumn(
        "health", F.when(F.col("error_rate") < HEALTHY_BELOW, "healthy").otherwise("degraded")
    )


def timeframe(ledger: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    recent = ledger.where(F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.agg(
        F.count(F.lit(1)).alias("operations"),
        F.coalesce(F.round(F.avg("duration"), 6), F.lit(0.0)).alias("average"),
    )


def duration_windows(ledger: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Operations and mean duration per time window, for a table or a stream."""
    frame = F.window("created_at", f"{hours} hours")
    return (
        ledger.withWatermark("created_at", delay)
        .groupBy(frame.alias("frame"))
        .agg(F.count(F.lit(1)).alias("operations"), F.avg("duration").alias("average"))
    )


def model(ledger: DataFrame) -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        n("completed").alias("successful"),
        n("failed").alias("failed"),
        n("pending").alias("pending"),
        n("conflict").alias("conflicts"),
        F.max(F.when(F.col("status") == "completed", F.col("created_at"))).alias("last_sync"),
        F.round(F.avg("duration"), 6).alias("average"),
    )


def mapping_counts(mappings: DataFrame) -> DataFrame:
    return mappings.agg(
        F.count(F.lit(1)).alias("mappings"),
        F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"),
    )
