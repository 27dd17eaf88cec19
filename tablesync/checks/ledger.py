"""Ledger views and metrics."""

from pyspark.sql import functions as F

from tablesync.checks.registry import query as register
from tablesync.checks.views import Tables
from tablesync.plans import ledger as lg
from tablesync.plans import metrics as mt


SQL: dict[str, str] = {}


def query(name: str, sql: str):
    SQL[name] = sql
    return register(name, sql)


def _ledger(t: Tables):
    """Stamps as instants, so that intervals and order mean the same everywhere."""
    rows = t("ledger")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "completed_at")})


def _newest(t: Tables):
    return t("events").agg(F.max(F.col("ts").cast("timestamp")).alias("now")).scalar()


@query("plan_retries", """
SELECT op_id, CASE WHEN status = 'failed' AND retry_count < 3 THEN 'pending' ELSE status END AS status,
       cast(CASE WHEN status = 'failed' AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS int) AS retry_count,
       status = 'failed' AND retry_count < 3 AS requeued, status = 'failed' AND retry_count >= 3 AS dead_letter
FROM ledger""")
def plan_retries(t: Tables):
    return lg.plan_retries(_ledger(t)).select(
        "op_id", "status", "retry_count", "requeued", "dead_letter"
    )


_RESULTS = """
SELECT concat('op', cast(event_id AS string)) AS op_id, value < 50 AS ok,
       CASE WHEN value >= 50 THEN concat('timeout ', cast(user_id AS string)) END AS error, ts AS at
FROM events"""


@query("ledger_transition", f"""
SELECT l.op_id, CASE WHEN l.status = 'processing' THEN 'failed' ELSE l.status END AS status,
       CASE WHEN l.status = 'processing' THEN r.error ELSE l.error END AS error, l.status = 'processing' AS has_time
FROM ledger l JOIN ({_RESULTS}) r ON r.op_id = l.op_id
WHERE NOT (l.status = 'processing' AND r.ok)""")
def ledger_transition(t: Tables):
    out = lg.transition(_ledger(t), t.sql(_RESULTS))
    return out.select("op_id", "status", "error", F.col("failed_at").isNotNull().alias("has_time"))


@query("queue_status", """
SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status IN ('pending', 'processing', 'failed')) AS total FROM ledger""")
def queue_status(t: Tables):
    return lg.queue_status(_ledger(t))


@query("ledger_lookup", """
SELECT op_id, source, entity, operation, status, retry_count FROM ledger WHERE op_id = 'op77'""")
def ledger_lookup(t: Tables):
    return lg.lookup(_ledger(t), "op77").select(
        "op_id", "source", "entity", "operation", "status", "retry_count"
    )


@query("failed_topk", """
SELECT op_id, source, error, retry_count FROM ledger WHERE status = 'failed' ORDER BY created_at DESC, op_id DESC LIMIT 100""")
def failed_topk(t: Tables):
    return lg.failed_operations(_ledger(t)).select("op_id", "source", "error", "retry_count")


@query("ledger_retention", """
SELECT op_id, status FROM ledger, (SELECT max(ts) AS now FROM events) n
WHERE NOT (status = 'completed' AND completed_at < now - INTERVAL 7 DAY)""")
def ledger_retention(t: Tables):
    return lg.retain(_ledger(t), _newest(t)).select("op_id", "status")


@query("metric_events_by_source", "SELECT source, count(*) AS n FROM ledger GROUP BY source")
def metric_events_by_source(t: Tables):
    return mt.counts(_ledger(t), "source")


@query("metric_ops", """
SELECT concat(operation, '_', status) AS metric, count(*) AS n FROM ledger GROUP BY operation, status""")
def metric_ops(t: Tables):
    return mt.operation_counts(_ledger(t))


@query("metric_errors", """
SELECT concat(error, '_', source) AS metric, count(*) AS n FROM ledger WHERE status = 'failed' GROUP BY error, source""")
def metric_errors(t: Tables):
    return mt.error_counts(_ledger(t))


@query("metric_conflicts", """
SELECT entity, count(*) AS n FROM ledger WHERE status = 'conflict' GROUP BY entity""")
def metric_conflicts(t: Tables):
    return mt.conflict_counts(_ledger(t))


@query("metric_retries", """
SELECT op_id, cast(sum(retry_count) AS bigint) AS n FROM ledger WHERE retry_count > 0 GROUP BY op_id""")
def metric_retries(t: Tables):
    return mt.retry_counts(_ledger(t))


@query("metric_durations", """
WITH last AS (SELECT duration, row_number() OVER (ORDER BY created_at DESC, op_id DESC) AS r FROM ledger)
SELECT round(avg(duration), 6) AS average, count(*) AS samples,
       (SELECT string_agg(printf('%.2f', duration), ',' ORDER BY r) FROM last WHERE r <= 10) AS recent
FROM last WHERE r <= 1000""")
def metric_durations(t: Tables):
    shown = F.transform("recent", lambda d: F.format_string("%.2f", d))
    return mt.duration_stats(_ledger(t)).withColumn("recent", F.array_join(shown, ","))


@query("metric_rates", """
SELECT round_even(count(*) FILTER (WHERE status = 'completed') / count(*) * 100, 2) AS success_rate,
       round_even(count(*) FILTER (WHERE status = 'failed') / count(*) * 100, 2) AS error_rate FROM ledger""")
def metric_rates(t: Tables):
    return mt.rates(_ledger(t))


@query("metric_summary", """
SELECT count(DISTINCT event_id) AS total_events, count(*) AS total_operations,
       count(*) FILTER (WHERE status = 'failed') AS total_errors, count(*) FILTER (WHERE status = 'conflict') AS total_conflicts,
       cast(sum(retry_count) AS bigint) AS total_retries,
       round_even(count(*) FILTER (WHERE status = 'failed') / count(*) * 100, 2) AS error_rate,
       CASE WHEN count(*) FILTER (WHERE status = 'failed') / count(*) * 100 < 10 THEN 'healthy' ELSE 'degraded' END AS health
FROM ledger""")
def metric_summary(t: Tables):
    return mt.summary(_ledger(t))


@query("metric_timeframe", """
SELECT count(*) AS operations, coalesce(round(avg(duration), 6), 0.0) AS average
FROM ledger, (SELECT max(ts) AS now FROM events) n WHERE created_at > now - INTERVAL 24 HOUR""")
def metric_timeframe(t: Tables):
    return mt.timeframe(_ledger(t), _newest(t))


@query("metric_windows", """
SELECT epoch_us(time_bucket(INTERVAL 24 HOUR, created_at, TIMESTAMP '1970-01-01')) AS start, count(*) AS operations,
       round(avg(duration), 6) AS average FROM ledger GROUP BY 1""")
def metric_windows(t: Tables):
    out = mt.duration_windows(_ledger(t))
    return out.select(
        F.unix_micros("frame.start").alias("start"), "operations", F.round("average", 6).alias("average")
    )


@query("metric_model", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'conflict') AS conflicts,
       epoch_us(max(created_at) FILTER (WHERE status = 'completed')) AS last_sync, round(avg(duration), 6) AS average
FROM ledger""")
def metric_model(t: Tables):
    return mt.model(_ledger(t)).withColumn("last_sync", F.unix_micros("last_sync"))


@query("mapping_counts", """
SELECT count(*) AS mappings, count(*) FILTER (WHERE coalesce(enabled, true)) AS enabled FROM mapping_rows""")
def mapping_counts(t: Tables):
    return mt.mapping_counts(t("mapping_rows"))
