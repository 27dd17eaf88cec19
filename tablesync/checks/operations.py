"""The ledger that the engine itself writes: two attempts, then views and metrics over it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.checks import ledger as views
from tablesync.checks.registry import query
from tablesync.checks.sync import MALFORMED_ROWS, MALFORMED_SQL, _batch, malformed_events
from tablesync.checks.views import Tables
from tablesync.plans import ledger as lg
from tablesync.plans import metrics as mt
from tablesync.plans import operations as op
from tablesync.session import stage

# every broken record fails twice; an attempt ends one or two hours after the last event
_OPS = f"""{MALFORMED_SQL},
rows_ AS ({MALFORMED_ROWS}),
ops AS (
  SELECT concat('op', cast(l.event_id AS string), '/', coalesce(l.direction, '-')) AS op_id, l.event_id, e.ts AS created_at,
         CASE WHEN l.status = 'success' THEN now + INTERVAL 1 HOUR END AS completed_at, l.source, l.entity, l.operation,
         CASE l.status WHEN 'success' THEN 'completed' WHEN 'error' THEN 'failed' ELSE l.status END AS status,
         CASE WHEN l.status = 'error' THEN l.reason END AS error,
         CASE WHEN l.status = 'error' THEN 1 ELSE 0 END AS retry_count,
         (epoch_us(now) - epoch_us(e.ts)) / 1e6 + CASE WHEN l.status = 'error' THEN 7200 ELSE 3600 END AS duration
  FROM rows_ l JOIN events e USING (event_id), (SELECT max(ts) AS now FROM events) n)"""

_DONE: dict[tuple[str, str], DataFrame] = {}


def engine_ledger(t: Tables) -> DataFrame:
    """The states of all operations after a batch and a retry of what failed in it. Written once
    per session and folder: all views read the same ledger."""
    place = t.spark.sparkContext.applicationId, t.folder
    if place not in _DONE:
        events = malformed_events(t)
        end = events.agg(F.timestamp_micros(F.max("us")).alias("now")).scalar()
        first = stage(op.attempts(_batch(t, events=events).ledger, events, end + F.expr("INTERVAL 1 HOUR")), "attempts")
        again = stage(op.reinjected(events, op.operations(first)), "again")
        second = op.attempts(_batch(t, events=again).ledger, again, end + F.expr("INTERVAL 2 HOURS"), attempt=2)
        _DONE[place] = stage(op.operations(first.unionByName(second)), "operations")
    return _DONE[place]


@query("engine_operations", _OPS + """
SELECT op_id, event_id, source, entity, operation, status, error, retry_count, epoch_us(completed_at) AS done_us FROM ops""")
def engine_operations(t: Tables):
    return engine_ledger(t).select(
        "op_id", "event_id", "source", "entity", "operation", "status", "error", "retry_count",
        F.unix_micros("completed_at").alias("done_us"),
    )


def _same(name: str):
    """A view of the ledger, read from the engine's own: same SQL over the other table."""
    sql = _VIEW_SQL[name].replace("FROM ledger", "FROM ops")
    body = sql.strip()
    joined = f"{_OPS}, {body[len('WITH '):]}" if body.startswith("WITH ") else f"{_OPS}\n{body}"
    return query(f"engine_{name}", joined)


_VIEW_SQL = views.SQL


@_same("plan_retries")
def engine_plan_retries(t: Tables):
    return lg.plan_retries(engine_ledger(t)).select("op_id", "status", "retry_count", "requeued", "dead_letter")


@_same("queue_status")
def engine_queue_status(t: Tables):
    return lg.queue_status(engine_ledger(t))


@_same("failed_topk")
def engine_failed_topk(t: Tables):
    return lg.failed_operations(engine_ledger(t)).select("op_id", "source", "error", "retry_count")


@_same("metric_ops")
def engine_metric_ops(t: Tables):
    return mt.operation_counts(engine_ledger(t))


@_same("metric_errors")
def engine_metric_errors(t: Tables):
    return mt.error_counts(engine_ledger(t))


@_same("metric_retries")
def engine_metric_retries(t: Tables):
    return mt.retry_counts(engine_ledger(t))


@_same("metric_rates")
def engine_metric_rates(t: Tables):
    return mt.rates(engine_ledger(t))


@_same("metric_summary")
def engine_metric_summary(t: Tables):
    return mt.summary(engine_ledger(t))


@_same("metric_model")
def engine_metric_model(t: Tables):
    return mt.model(engine_ledger(t)).withColumn("last_sync", F.unix_micros("last_sync"))


@_same("metric_durations")
def engine_metric_durations(t: Tables):
    shown = F.transform("recent", lambda d: F.format_string("%.2f", d))
    return mt.duration_stats(engine_ledger(t)).withColumn("recent", F.array_join(shown, ","))
