"""Matching, conflicts, merges and whole sync batches."""

import json
import uuid

from pyspark.sql import functions as F

from tablesync import presets
from tablesync.checks.identity import GATE_CTES, SIX_HOURS_MS, micros
from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.operators import apply as ap
from tablesync.operators import conflict as cf
from tablesync.operators import mapping as m
from tablesync.operators import match
from tablesync.plans.conflicts import INCOMING, TARGET, pending
from tablesync.plans.conflicts import resolve_manual as decide_manual
from tablesync.plans.sync_batch import Side, SyncResult, sync_batch as run_batch
from tablesync.profiles import A2B, B2A, MappingSpec
from tablesync.session import checkpoint_root, stage
from tablesync.sources.buckets import BucketTable

A_PERSON = (
    "name string, first_name string, last_name string, cell_number string, personal_email string, "
    "prefered_email string, company string, status string, modified string"
)
B_PERSON = (
    "id string, name string, email string, phone_number string, _legacy_is_active boolean, "
    "organization_id string, updated_at string"
)
A_TASK = (
    "name string, subject string, status string, act_start_date string, exp_start_date string, "
    "description string, is_milestone int, organization_id string, modified string"
)
B_TASK = (
    "id string, task_name string, status string, start_date string, page_content string, "
    "needs_submission boolean, organization_id string, updated_at string"
)
_B_TASK_TABLE = "id, task_name, status, start_date, page_content, needs_submission, organization_id, updated_at"


def _events(t: Tables):
    """The change events, landed as a table: the batch reads them from there."""
    return stage(t("landed_events").withColumn("us", micros()).drop("ts"), "landed")


def _batch(t: Tables, merge: bool = False, specs=presets.ALL, events=None) -> SyncResult:
    return run_batch(
        _events(t) if events is None else events,
        specs,
        {"Employee": Side(A_PERSON, t("a_person")), "Task": Side(A_TASK, t("a_task"))},
        {"users": Side(B_PERSON, t("b_person")), "tasks": Side(B_TASK, t("b_task"))},
        window_ms=SIX_HOURS_MS,
        merge=merge,
    )


# --- the batch in SQL: gates played in order, then one row per event with its outcome ---

_SNIP = r"regexp_replace(replace(substring({0}, 1, 50), chr(10), ' '), '^\s+|\s+$', '', 'g')"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_PHONE = f"CASE WHEN length({_DIGITS}) >= 10 THEN right({_DIGITS}, 10) END"

BATCH_CTES = f"""
r AS (
  SELECT *, epoch_us(ts) AS us,
         CASE kind WHEN 'person' THEN 'Employee' WHEN 'task' THEN 'Task' ELSE entity END AS canon,
         coalesce(original_source IN ('a', 'b') AND original_source <> source, false) AS returns
  FROM event_records),
base AS (
  SELECT event_id, us, source, kind <> 'other' AND NOT returns AS may,
         concat(canon, ':', CASE
           WHEN kind = 'person' AND source = 'a' THEN
             coalesce(concat('phone:', nullif({_PHONE.format('cell_number')}, '')), concat('email:', nullif(personal_email, '')))
           WHEN kind = 'person' THEN
             coalesce(concat('phone:', nullif({_PHONE.format('phone_number')}, '')), concat('email:', nullif(email, '')))
           WHEN kind = 'task' THEN
             concat('subject:', CASE WHEN source = 'a' THEN subject ELSE task_name END,
                    coalesce(concat('_desc:', nullif({_SNIP.format("CASE WHEN source = 'a' THEN description ELSE page_content END")}, '')), ''))
           ELSE concat('name:INV-', cast(user_id AS string)) END) AS who0
  FROM r)"""
# duckdb's concat skips nulls, so missing identities are found by their bare prefixes
BATCH_CTES = BATCH_CTES.replace("base AS (", "base0 AS (") + """,
base AS (
  SELECT event_id, us, source, may,
         CASE WHEN who0 IN ('Employee:', 'Employee:phone:', 'Employee:email:', 'Task:', 'Task:subject:') THEN NULL
              WHEN who0 LIKE 'Employee:phone:' THEN NULL ELSE who0 END AS who
  FROM base0)"""
BATCH_CTES = BATCH_CTES.replace("concat('phone:', nullif(", "('phone:' || nullif(").replace(
    "concat('email:', nullif(", "('email:' || nullif("
).replace("coalesce(concat('_desc:', nullif(", "coalesce(('_desc:' || nullif(").replace(
    "concat('subject:', CASE", "'subject:' || concat(CASE"
)


def _route_sql(name, source, kind, entity, way, mapped_key, stamp, target, t_key, t_id, t_stamp,
               text, t_text, pairs, a_type, missing, key_sql):
    """Outcome rows of one route; `pairs` are (field, mapped value, target column)."""
    clash = " + ".join(f"(CASE WHEN {v} <> tt.{c} THEN 1 ELSE 0 END)" for _, v, c in pairs)
    fields = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {v} <> tt.{c} THEN '{f}' END" for f, v, c in pairs) + ")"
    verified = f"({_SNIP.format(text)} IS NULL OR {_SNIP.format(text)} = '' OR contains(coalesce(d.{t_text}, ''), {_SNIP.format(text)}))" if text else "true"
    incoming_newer = (
        f"cast(replace(replace({stamp}, 'T', ' '), 'Z', '') AS timestamp) > cast(replace(replace(tt.{t_stamp}, 'T', ' '), 'Z', '') AS timestamp)"
        if source == "a" else
        f"NOT (cast(replace(replace(tt.{t_stamp}, 'T', ' '), 'Z', '') AS timestamp) > cast(replace(replace({stamp}, 'T', ' '), 'Z', '') AS timestamp))"
    )
    return f"""
{name}_dim AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {t_key} ORDER BY {t_id}) AS pick FROM {target}
                 WHERE {t_key} IS NOT NULL AND {t_key} <> '') WHERE pick = 1),
{name}_m AS (
  SELECT r.*, {mapped_key} AS mv, d.{t_id} AS any_id, CASE WHEN {verified} THEN d.{t_id} END AS tid
  FROM r JOIN gates g ON g.event_id = r.event_id AND g.gate IS NULL
  LEFT JOIN {name}_dim d ON d.{t_key} = {mapped_key}
  WHERE r.source = '{source}' AND r.kind = '{kind}' AND NOT r.returns),
{name}_o AS (
  SELECT *, CASE WHEN mv IS NULL THEN false
                 ELSE coalesce(lag(operation) OVER (PARTITION BY mv ORDER BY us, event_id) <> 'delete',
                               CASE WHEN operation = 'delete' THEN any_id ELSE tid END IS NOT NULL) END AS there
  FROM {name}_m),
{name} AS (
  SELECT o.event_id, '{source}' AS source, '{entity}' AS entity, o.record_id_, '{way}' AS direction,
         CASE WHEN o.operation = 'delete' THEN 'delete' WHEN there THEN 'update' ELSE 'create' END AS operation,
         CASE WHEN o.operation <> 'delete' AND there AND o.tid IS NOT NULL AND ({clash}) > 0 AND NOT ({incoming_newer}) THEN 'skipped' ELSE 'success' END AS status,
         CASE WHEN o.operation = 'delete' THEN CASE WHEN mv IS NULL THEN '{missing}' WHEN NOT there THEN 'record_not_found' END
              WHEN there AND o.tid IS NOT NULL AND ({clash}) > 0 AND NOT ({incoming_newer}) THEN 'target_wins' END AS reason,
         CASE WHEN o.operation = 'delete' AND NOT there THEN NULL
              ELSE coalesce(CASE WHEN o.operation = 'delete' THEN any_id ELSE tid END, {key_sql.format("coalesce(mv, record_id_)")}) END AS target_id,
         CASE WHEN o.operation <> 'delete' AND there AND o.tid IS NOT NULL THEN {fields} ELSE '' END AS conflict_fields
  FROM (SELECT *, cast(user_id AS string) AS record_id_ FROM {name}_o) o
  LEFT JOIN {target} tt ON tt.{t_id} = o.tid)"""


def _uuid_sql(entity: str) -> str:
    h = f"sha256(concat('{entity}/', {{0}}))"
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substring({h}, {s}, {n})" for s, n in parts) + ")"


_ROUTES = ",".join([
    _route_sql(
        "pa", "a", "person", "Employee", "a2b",
        "coalesce(nullif(personal_email, ''), nullif(prefered_email, ''))", "stamp",
        "b_person", "email", "id", "updated_at", None, None,
        [("personal_email", "coalesce(nullif(personal_email, ''), nullif(prefered_email, ''))", "email"),
         ("cell_number", "nullif(cell_number, '')", "phone_number"),
         ("status", "(ap_status = 'Active')", "_legacy_is_active"),
         ("company", "nullif(o.company, '')", "organization_id")],
        "Employee", "no_email_for_lookup", _uuid_sql("Employee")),
    _route_sql(
        "pb", "b", "person", "users", "b2a", "nullif(email, '')", "concat(replace(stamp, ' ', 'T'), 'Z')",
        "a_person", "personal_email", "name", "modified", None, None,
        [("name", "coalesce(split_part(bp_name, ' ', 1), '')", "first_name"),
         ("email", "coalesce(o.email, '')", "personal_email"),
         ("phone_number", "coalesce(o.phone_number, '')", "cell_number"),
         ("_legacy_is_active", "CASE WHEN bp_active = 'true' THEN 'Active' ELSE 'Inactive' END", "status"),
         ("organization_id", "coalesce(bp_org, '')", "company"),
         ("last_name", "CASE WHEN contains(bp_name, ' ') THEN substring(bp_name, strpos(bp_name, ' ') + 1) ELSE '' END", "last_name")],
        "Employee", "no_email_for_lookup", _uuid_sql("Employee")),
    _route_sql(
        "ta", "a", "task", "Task", "a2b", "nullif(subject, '')", "stamp",
        "b_task", "task_name", "id", "updated_at", "description", "page_content",
        [("subject", "nullif(o.subject, '')", "task_name"), ("status", "at_status", "status"),
         ("act_start_date", "coalesce(act_start_date, exp_start_date)", "start_date"),
         ("is_milestone", "(is_milestone <> 0)", "needs_submission"),
         ("modified", "replace(stamp, ' ', 'T')", "updated_at"),
         ("description", "nullif(o.description, '')", "page_content"),
         ("organization_id", f"coalesce(at_org, '{presets.ORGANIZATION_ID}')", "organization_id")],
        "Task", "no_task_name_for_lookup", _uuid_sql("Task")),
    _route_sql(
        "tb", "b", "task", "tasks", "b2a", "nullif(task_name, '')", "concat(replace(stamp, ' ', 'T'), 'Z')",
        "a_task", "subject", "name", "modified", "page_content", "description",
        [("task_name", "coalesce(o.task_name, '')", "subject"), ("status", "coalesce(bt_status, '')", "status"),
         ("start_date", "coalesce(split_part(o.start_date, 'T', 1), '')", "act_start_date"),
         ("needs_submission", "cast(o.needs_submission AS int)", "is_milestone"),
         ("updated_at", "stamp", "modified"),
         ("page_content", "coalesce(o.page_content, '')", "description")],
        "Task", "no_task_name_for_lookup", _uuid_sql("Task")),
])

BATCH_SQL = f"""
WITH RECURSIVE {BATCH_CTES},
{GATE_CTES},
{_ROUTES},
outcomes AS (
  SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM ta UNION ALL SELECT * FROM tb
  UNION ALL
  SELECT r.event_id, r.source, r.entity, cast(r.user_id AS string) AS record_id_,
         CASE WHEN kind = 'other' OR returns THEN NULL WHEN r.source = 'a' THEN 'a2b' ELSE 'b2a' END AS direction,
         r.operation, 'skipped' AS status,
         CASE WHEN g.gate = 'duplicate' THEN 'duplicate_webhook'
              WHEN g.gate = 'echo' THEN 'opposite_service_webhook_after_sync'
              WHEN kind = 'other' AND r.source = 'a' THEN 'doctype_not_configured'
              WHEN kind = 'other' THEN 'table_not_configured' ELSE 'direction_not_allowed' END AS reason,
         NULL AS target_id, '' AS conflict_fields
  FROM r JOIN gates g ON g.event_id = r.event_id WHERE g.gate IS NOT NULL OR kind = 'other' OR returns)
"""


@query("sync_batch", BATCH_SQL + """
SELECT event_id, source, entity, record_id_ AS record_id, direction, operation, status, reason, target_id, conflict_fields
FROM outcomes""")
def sync_batch(t: Tables):
    ledger = _batch(t).ledger
    return ledger.withColumn("conflict_fields", F.array_join("conflict_fields", ","))



LEDGER_COLUMNS = """
SELECT event_id, source, entity, record_id_ AS record_id, direction, operation, status, reason, target_id, conflict_fields
FROM outcomes"""
_DIRECTION = "CASE WHEN kind = 'other' OR returns THEN NULL WHEN source = 'a' THEN 'a2b' ELSE 'b2a' END"


def _shown(result: SyncResult):
    return result.ledger.withColumn("conflict_fields", F.array_join("conflict_fields", ","))


@query("sync_redelivered", BATCH_SQL + f"""{LEDGER_COLUMNS}
UNION ALL
SELECT event_id, source, entity, cast(user_id AS string), {_DIRECTION}, operation, 'skipped', 'duplicate_webhook', NULL, ''
FROM r WHERE event_id % 5 = 0""")
def sync_redelivered(t: Tables):
    """Every fifth event is delivered twice: one is applied, the other is a duplicate."""
    events = _events(t)
    again = events.where("event_id % 5 = 0")
    return _shown(_batch(t, events=events.unionByName(again)))


# a filtered event has no success that an echo could follow
_FILTERED = (
    "kind = 'task' AND CASE WHEN coalesce(CASE WHEN source = 'a' THEN at_status ELSE bt_status END) IS NULL "
    "THEN operation <> 'delete' ELSE CASE WHEN source = 'a' THEN at_status ELSE bt_status END <> 'O' END"
)
FILTERED_SQL = (
    BATCH_SQL.replace("AS returns\n", f"AS returns,\n         coalesce({_FILTERED}, false) AS apart\n")
    .replace("kind <> 'other' AND NOT returns AS may", "kind <> 'other' AND NOT returns AND NOT apart AS may")
    .replace("AND NOT r.returns)", "AND NOT r.returns AND NOT r.apart)")
    .replace("'table_not_configured' ELSE", "'table_not_configured' WHEN NOT returns THEN 'filtered_out' ELSE")
    .replace("OR kind = 'other' OR returns)", "OR kind = 'other' OR returns OR apart)")
)


@query("sync_filtered", FILTERED_SQL + LEDGER_COLUMNS)
def sync_filtered(t: Tables):
    """Tasks pass their mapping's filter or end as filtered_out."""
    task = presets.TASK.with_(filters={"status": "O"})
    return _shown(_batch(t, specs=(task, presets.PERSON)))


MALFORMED_SQL = BATCH_SQL.replace("FROM event_records)", "FROM event_records WHERE event_id % 7 <> 3)", 1)
MALFORMED_ROWS = LEDGER_COLUMNS + f"""
UNION ALL
SELECT event_id, source, entity, cast(user_id AS string), {_DIRECTION}, operation,
       CASE WHEN {_DIRECTION} IS NULL THEN 'skipped' WHEN operation = 'delete' THEN 'success' ELSE 'error' END,
       CASE WHEN kind = 'other' AND source = 'a' THEN 'doctype_not_configured' WHEN kind = 'other' THEN 'table_not_configured'
            WHEN returns THEN 'direction_not_allowed' WHEN operation <> 'delete' THEN 'malformed_record'
            WHEN kind = 'person' THEN 'no_email_for_lookup' ELSE 'no_task_name_for_lookup' END, NULL, ''
FROM (SELECT *, coalesce(original_source IN ('a', 'b') AND original_source <> source, false) AS returns
      FROM event_records WHERE event_id % 7 = 3) q"""


@query("sync_malformed", MALFORMED_SQL + MALFORMED_ROWS)
def sync_malformed(t: Tables):
    """Every seventh record breaks off: it writes nothing and ends as an error."""
    return _shown(_batch(t, events=malformed_events(t)))


def malformed_events(t: Tables):
    broken = F.when(F.col("event_id") % 7 == 3, '{"name": broken').otherwise(F.col("data"))
    return _events(t).withColumn("data", broken)


@query("sync_from_config", BATCH_SQL + LEDGER_COLUMNS)
def sync_from_config(t: Tables):
    """The task mapping as a file gives it, without match keys: the same outcomes."""
    spec = presets.TASK
    conf = {
        "a_type": spec.a_type, "b_table": spec.b_table, "field_mappings": dict(spec.fields_a2b),
        "reverse_mappings": dict(spec.fields_b2a), "complex_mappings": dict(spec.derive_a2b),
        "reverse_complex_mappings": dict(spec.derive_b2a), "sync_fields": list(spec.sync_fields),
        "conflict_resolution": spec.strategy, "direction": spec.direction,
    }
    loaded = MappingSpec.from_dict(spec.name, json.loads(json.dumps(conf)))
    return _shown(_batch(t, specs=(loaded, presets.PERSON)))


# tasks in SQL whose conflicts wait for a person: what the batch found, and both records
_CLASHES = BATCH_SQL + """,
clashes AS (
  SELECT o.event_id, o.us, o.direction, o.target_id, o.conflict_fields, r.at_status, r.bt_status,
         b.status AS b_now, a.status AS a_now
  FROM (SELECT o.*, epoch_us(e.ts) AS us FROM outcomes o JOIN event_records e USING (event_id)) o
  JOIN event_records r USING (event_id) LEFT JOIN b_task b ON b.id = o.target_id LEFT JOIN a_task a ON a.name = o.target_id
  WHERE o.conflict_fields <> '' AND r.kind = 'task')"""
_INCOMING = "CASE direction WHEN 'a2b' THEN at_status ELSE coalesce(bt_status, '') END"


def _manual(t: Tables) -> SyncResult:
    return _batch(t, specs=(presets.TASK.with_(strategy="manual"), presets.PERSON))


@query("conflicts", _CLASHES + f"""
SELECT event_id, direction, target_id, 'conflict' AS status, conflict_fields, {_INCOMING} AS incoming_status,
       CASE direction WHEN 'a2b' THEN b_now ELSE a_now END AS existing_status FROM clashes""")
def conflicts(t: Tables):
    """Conflicts of tasks under the manual strategy, with both records."""
    found = pending(_manual(t).conflicts)
    return found.select(
        "event_id", "direction", "target_id", "status", F.array_join("conflict_fields", ",").alias("conflict_fields"),
        F.get_json_object("incoming", "$.status").alias("incoming_status"),
        F.get_json_object("existing", "$.status").alias("existing_status"),
    )


_SETTLED = """
SELECT target_id, arg_max({0}, (us, event_id)) AS status FROM clashes
WHERE direction = '{1}' AND event_id % 3 = 0 GROUP BY target_id"""


@query("resolve_manual", _CLASHES + f"""
SELECT 'b' AS side, id, coalesce(s.status, t.status) AS status FROM b_task t
LEFT JOIN ({_SETTLED.format("at_status", "a2b")}) s ON s.target_id = t.id
UNION ALL SELECT 'a', name, coalesce(s.status, t.status) FROM a_task t
LEFT JOIN ({_SETTLED.format("coalesce(bt_status, '')", "b2a")}) s ON s.target_id = t.name""")
def resolve_manual(t: Tables):
    """Every third conflict is decided for the incoming record, every other for the target."""
    found = stage(_manual(t).conflicts, "conflicts")
    winner = F.when(F.col("event_id") % 3 == 0, INCOMING).when(F.col("event_id") % 3 == 1, TARGET).otherwise("?")
    decisions = found.select("event_id", "mapping", winner.alias("winner"))
    after = decide_manual(found, decisions, {("b", "tasks"): t("b_task"), ("a", "Task"): t("a_task")})
    b, a = after["b", "tasks"], after["a", "Task"]
    return b.select(F.lit("b").alias("side"), "id", "status").unionByName(
        a.select(F.lit("a").alias("side"), F.col("name").alias("id"), "status")
    )


@query("resolve_operation", """
WITH dim AS (SELECT task_name, min(id) AS id FROM b_task GROUP BY task_name),
m AS (SELECT r.*, epoch_us(ts) AS us, d.id AS target_id FROM event_records r LEFT JOIN dim d ON d.task_name = r.subject),
o AS (SELECT *, CASE WHEN subject IS NULL THEN false ELSE coalesce(lag(operation) OVER (PARTITION BY subject ORDER BY us, event_id) <> 'delete',
                                                                   target_id IS NOT NULL) END AS there FROM m)
SELECT event_id, target_id, CASE WHEN operation = 'delete' THEN 'delete' WHEN there THEN 'update' ELSE 'create' END AS resolved
FROM o""")
def resolve_operation(t: Tables):
    rows = t("event_records").select("event_id", micros().alias("us"), "operation", "subject")
    found = match.first_by(t("b_task"), F.col("task_name"), "id")
    rows = rows.join(found, rows["subject"] == found["_match"], "left").select(
        "event_id", "us", "operation", F.col("subject").alias("match_value"),
        F.col("_target_id").alias("target_id"),
    )
    return match.resolve_operation(rows).select("event_id", "target_id", "resolved")


@query("match_task", f"""
SELECT a.name, min(CASE WHEN a.description IS NULL OR contains(d.page_content, {_SNIP.format('a.description')}) THEN d.id END) AS target_id,
       min(d.id) AS found_id
FROM a_task a LEFT JOIN b_task d ON d.task_name = a.subject GROUP BY a.name""")
def match_task(t: Tables):
    mapped = m.map_records(t("a_task"), presets.TASK, A2B, keep=("name",))
    found = match.find_targets(mapped, t("b_task"), presets.TASK, A2B, "id", salt="_name")
    return found.select(F.col("_name").alias("name"), "target_id", "found_id")


def _shared(subject: str) -> str:
    return f"concat('Order ', cast(cast(split_part({subject}, ' ', 2) AS bigint) % 40 AS string))"


@query("match_subject_all", f"""
WITH a AS (SELECT name, {_shared('subject')} AS subject, {_SNIP.format('description')} AS piece FROM a_task),
b AS (SELECT id, {_shared('task_name')} AS task_name, page_content FROM b_task)
SELECT a.name, min(CASE WHEN coalesce(piece, '') = '' OR contains(page_content, piece) THEN b.id END) AS target_id, min(b.id) AS found_id
FROM a LEFT JOIN b ON b.task_name = a.subject GROUP BY a.name""")
def match_subject_all(t: Tables):
    """Forty subjects for all tasks: every target of a subject is tested for the text."""
    source = t("a_task").withColumn("subject", F.expr(_shared("subject")))
    target = t("b_task").withColumn("task_name", F.expr(_shared("task_name")))
    mapped = m.map_records(source, presets.TASK, A2B, keep=("name",))
    found = match.find_targets(mapped, target, presets.TASK, A2B, "id", salt="_name")
    return found.select(F.col("_name").alias("name"), "target_id", "found_id")


_PAIRS = """
SELECT a.name, a.subject, a.status, a.act_start_date, a.modified, b.id, b.task_name, b.status AS t_status,
       b.start_date AS t_start_date, b.updated_at,
       CASE WHEN length(a.name) % 2 = 0 THEN NULL ELSE a.description END AS description, b.page_content AS t_page_content
FROM a_task a JOIN b_task b ON b.task_name = a.subject"""


@query("conflict_fields", f"""
SELECT name, concat_ws(',', CASE WHEN status <> t_status THEN 'status' END,
                            CASE WHEN act_start_date <> t_start_date THEN 'start' END,
                            CASE WHEN description <> t_page_content THEN 'text' END) AS fields FROM ({_PAIRS}) p""")
def conflict_fields(t: Tables):
    pairs = t.sql(_PAIRS)
    fields = cf.conflict_fields(
        {
            "status": (F.col("status"), F.col("t_status")),
            "start": (F.col("act_start_date"), F.col("t_start_date")),
            "text": (F.col("description"), F.col("t_page_content")),
        }
    )
    return pairs.select("name", F.array_join(fields, ",").alias("fields"))


@query("detect_conflicts", """
WITH dim AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS pick FROM b_person),
a AS (SELECT *, coalesce(nullif(personal_email, ''), nullif(prefered_email, '')) AS addr FROM a_person)
SELECT a.name, d.id AS target_id, 'last_modified_wins' AS strategy,
       concat_ws(',', CASE WHEN a.cell_number <> d.phone_number THEN 'cell_number' END,
                      CASE WHEN (a.status = 'Active') <> d._legacy_is_active THEN 'status' END,
                      CASE WHEN a.company <> d.organization_id THEN 'company' END) AS fields
FROM a JOIN dim d ON d.email = a.addr AND d.pick = 1
WHERE a.cell_number <> d.phone_number OR (a.status = 'Active') <> d._legacy_is_active OR a.company <> d.organization_id""")
def detect_conflicts(t: Tables):
    mapped = m.map_records(t("a_person"), presets.PERSON, A2B, keep=("name",))
    target = t("b_person")
    payload = tuple(c for c in target.columns if c in mapped.columns)
    found = match.find_targets(mapped, target, presets.PERSON, A2B, "id", payload, salt="_name")
    found = found.withColumn("operation", F.lit("update"))
    out = cf.detect_conflicts(found, presets.PERSON, A2B).where(F.size("conflict_fields") > 0)
    return out.select(
        F.col("_name").alias("name"), "target_id", "strategy",
        F.array_join("conflict_fields", ",").alias("fields"),
    )


_STAMP_PAIRS = """
SELECT a.name, b.id, CASE WHEN a.is_milestone = 1 AND a.status = 'O' THEN NULL ELSE a.modified END AS a_stamp,
       CASE WHEN b.task_name LIKE '%7' THEN NULL ELSE b.updated_at END AS b_stamp, a.status AS a_status, b.status AS b_status
FROM a_task a FULL OUTER JOIN b_task b ON b.task_name = a.subject"""
_A_NEWER = "cast(a_stamp AS timestamp) > cast(replace(replace(b_stamp, 'T', ' '), 'Z', '') AS timestamp)"


@query("resolve_last_modified", f"""
SELECT coalesce(name, id) AS rid,
       CASE WHEN id IS NULL THEN 'a' WHEN name IS NULL THEN 'b'
            WHEN a_stamp IS NOT NULL AND b_stamp IS NOT NULL THEN CASE WHEN {_A_NEWER} THEN 'a' ELSE 'b' END
            WHEN a_stamp IS NOT NULL THEN 'a' ELSE 'b' END AS winner
FROM ({_STAMP_PAIRS}) p""")
def resolve_last_modified(t: Tables):
    side = cf.last_modified(
        F.col("name").isNotNull(), F.col("id").isNotNull(), F.col("a_stamp"), F.col("b_stamp")
    )
    return t.sql(_STAMP_PAIRS).select(F.coalesce("name", "id").alias("rid"), side.alias("winner"))


@query("resolve_strategies", f"""
SELECT name, strategy, CASE strategy WHEN 'manual' THEN 'conflict' WHEN 'a_wins' THEN 'success' WHEN 'b_wins' THEN 'skipped'
                            ELSE CASE WHEN newer = 'a' THEN 'success' ELSE 'skipped' END END AS status,
       CASE strategy WHEN 'manual' THEN 'manual_resolution' WHEN 'b_wins' THEN 'target_wins' WHEN 'a_wins' THEN NULL
                     ELSE CASE WHEN newer = 'b' THEN 'target_wins' END END AS reason
FROM (SELECT name, split_part('last_modified_wins,a_wins,b_wins,manual', ',', cast(1 + length(b_status) % 4 + length(name) % 2 AS int)) AS strategy,
             CASE WHEN a_stamp IS NOT NULL AND b_stamp IS NOT NULL THEN CASE WHEN {_A_NEWER} THEN 'a' ELSE 'b' END
                  WHEN a_stamp IS NOT NULL THEN 'a' ELSE 'b' END AS newer
      FROM ({_STAMP_PAIRS}) p WHERE name IS NOT NULL AND id IS NOT NULL) q""")
def resolve_strategies(t: Tables):
    pairs = t.sql(_STAMP_PAIRS).where("name IS NOT NULL AND id IS NOT NULL")
    strategy = F.expr(
        "split_part('last_modified_wins,a_wins,b_wins,manual', ',', cast(1 + length(b_status) % 4 + length(name) % 2 AS int))"
    )
    pairs = pairs.withColumn("strategy", strategy).withColumn(
        "newer", cf.newer_side(F.col("a_stamp"), F.col("b_stamp"))
    )
    status, reason = cf.conflict_status(F.col("strategy"), F.col("newer"), F.lit("a"))
    return pairs.select("name", "strategy", status.alias("status"), reason.alias("reason"))


@query("resolve_pairs", f"""
SELECT rid, CASE WHEN ok THEN side END AS winner, CASE WHEN NOT ok THEN 'no_mapping' END AS error,
       CASE WHEN ok THEN CASE WHEN side = 'a' THEN a_status ELSE b_status END END AS status
FROM (SELECT coalesce(name, id) AS rid, a_status, b_status, coalesce(a_status, b_status) <> 'P' AS ok,
             CASE WHEN coalesce({_A_NEWER}, a_stamp IS NOT NULL AND b_stamp IS NULL) THEN 'a' ELSE 'b' END AS side
      FROM ({_STAMP_PAIRS}) p) q""")
def resolve_pairs(t: Tables):
    pairs = t.sql(_STAMP_PAIRS).withColumn("rid", F.coalesce("name", "id"))
    configured = F.coalesce("a_status", "b_status") != "P"
    out = cf.resolve_pairs(
        pairs, "a_stamp", "b_stamp", configured, [("status", "a_status", "b_status")]
    )
    return out.select("rid", "winner", "error", "status")


@query("reconcile", """
WITH a AS (SELECT coalesce(nullif(personal_email, ''), nullif(prefered_email, '')) AS identity, min(name) AS a_id FROM a_person GROUP BY 1),
b AS (SELECT nullif(email, '') AS identity, min(id) AS b_id FROM b_person GROUP BY 1)
SELECT coalesce(a.identity, b.identity) AS identity, a_id, b_id,
       CASE WHEN b_id IS NULL THEN 'only_a' WHEN a_id IS NULL THEN 'only_b' ELSE 'matched' END AS state
FROM (SELECT * FROM a WHERE identity IS NOT NULL) a FULL OUTER JOIN (SELECT * FROM b WHERE identity IS NOT NULL) b ON a.identity = b.identity""")
def reconcile(t: Tables):
    from tablesync.functions.text import first_non_empty, non_empty

    return match.reconcile(
        t("a_person"),
        first_non_empty(F.col("personal_email"), F.col("prefered_email")),
        "name",
        t("b_person"),
        non_empty(F.col("email")),
        "id",
    )


# --- merges -------------------------------------------------------------------------

# Changes to customers: the record fields change from event to event; some are absent.
_CHANGES = """
SELECT event_id, ts, user_id AS c_custkey,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
       concat('name ', cast(event_id AS string)) AS c_name,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS c_mktsegment,
       value AS c_acctbal, event_id % 3 = 0 AS has_name, event_id % 4 <> 0 AS has_segment
FROM events"""

_NET_CTES = f"""
ch AS (SELECT *, epoch_us(ts) AS us FROM ({_CHANGES}) c),
k AS (SELECT c_custkey, arg_max(operation, (us, event_id)) AS operation, count(*) AS n_changes,
             max((us, event_id)) FILTER (WHERE operation = 'delete') AS gone FROM ch GROUP BY c_custkey),
live AS (SELECT ch.* FROM ch JOIN k ON k.c_custkey = ch.c_custkey AND k.operation <> 'delete'
         WHERE ch.operation <> 'delete' AND (k.gone IS NULL OR (ch.us, ch.event_id) > k.gone)),
nm AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY us DESC, event_id DESC) AS r FROM live WHERE has_name),
sg AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY us DESC, event_id DESC) AS r FROM live WHERE has_segment),
bl AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY us DESC, event_id DESC) AS r FROM live),
net AS (SELECT k.c_custkey, k.operation, k.n_changes, k.gone IS NOT NULL AS reset, nm.c_name, sg.c_mktsegment, bl.c_acctbal,
               nm.c_custkey IS NOT NULL AS w_name, sg.c_custkey IS NOT NULL AS w_segment, bl.c_custkey IS NOT NULL AS w_bal
        FROM k LEFT JOIN nm ON nm.c_custkey = k.c_custkey AND nm.r = 1 LEFT JOIN sg ON sg.c_custkey = k.c_custkey AND sg.r = 1
        LEFT JOIN bl ON bl.c_custkey = k.c_custkey AND bl.r = 1)"""


def _net(t: Tables):
    changes = t.sql(_CHANGES).withColumn("us", micros())
    mask = F.array_compact(
        F.array(
            F.when(F.col("has_name"), F.lit("c_name")),
            F.when(F.col("has_segment"), F.lit("c_mktsegment")),
            F.lit("c_acctbal"),
        )
    )
    changes = changes.withColumn(m.PRESENT, mask).drop("ts", "has_name", "has_segment")
    return ap.net_changes(changes, "c_custkey")


@query("net_changes", f"""
WITH {_NET_CTES}
SELECT c_custkey, operation, n_changes, reset AS _reset, c_name, c_mktsegment, c_acctbal,
       concat_ws(',', CASE WHEN w_name THEN 'c_name' END, CASE WHEN w_segment THEN 'c_mktsegment' END,
                      CASE WHEN w_bal THEN 'c_acctbal' END) AS _present FROM net""")
def net_changes(t: Tables):
    return _net(t).withColumn(m.PRESENT, F.array_join(m.PRESENT, ","))


_APPLY_SQL = f"""
WITH {_NET_CTES}
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey,
       CASE WHEN n.w_name THEN n.c_name WHEN n.reset THEN NULL ELSE c.c_name END AS c_name,
       CASE WHEN n.reset THEN NULL ELSE c.c_nationkey END AS c_nationkey,
       CASE WHEN n.w_bal THEN n.c_acctbal WHEN n.reset THEN NULL ELSE c.c_acctbal END AS c_acctbal,
       CASE WHEN n.w_segment THEN n.c_mktsegment WHEN n.reset THEN NULL ELSE c.c_mktsegment END AS c_mktsegment
FROM customer c FULL OUTER JOIN net n ON n.c_custkey = c.c_custkey
WHERE n.operation IS NULL OR n.operation <> 'delete'"""


@query("apply_changes", _APPLY_SQL)
def apply_changes(t: Tables):
    """Insert, update and delete of many changes per key as one merge."""
    return ap.apply_changes(t("customer"), _net(t), "c_custkey")


@query("apply_buckets", _APPLY_SQL)
def apply_buckets(t: Tables):
    """The same changes played into a bucketed table: only touched buckets are written again."""
    table = BucketTable(t.spark, f"{checkpoint_root(t.spark)}/buckets-{uuid.uuid4().hex}", "c_custkey")
    table.commit(t("customer"), 0)
    table.merge(stage(_net(t), "net"), 1)
    return table.read()


def _merge_sql(route: str, target: str, key: str, columns: list[tuple[str, str]], source: str) -> str:
    """The target after one route's successful writes, in SQL: rank the writes per column."""
    ctes = ",\n".join(
        f"col_{c} AS (SELECT target_id, v_{c} AS v, row_number() OVER (PARTITION BY target_id ORDER BY us DESC, event_id DESC) AS r"
        f" FROM mlive WHERE p_{c})" for c, _ in columns)
    joins = "\n".join(f"LEFT JOIN col_{c} ON col_{c}.target_id = n.target_id AND col_{c}.r = 1" for c, _ in columns)
    return BATCH_SQL.rstrip() + f""",
w AS (
  SELECT x.target_id, x.operation, r.us, x.event_id, {source}
  FROM {route} x JOIN r ON r.event_id = x.event_id
  WHERE x.status = 'success' AND x.target_id IS NOT NULL AND (x.reason IS NULL OR x.reason NOT IN ('record_not_found', 'no_email_for_lookup', 'no_task_name_for_lookup'))),
mk AS (SELECT target_id, arg_max(operation, (us, event_id)) AS op, max((us, event_id)) FILTER (WHERE operation = 'delete') AS gone
       FROM w GROUP BY target_id),
mlive AS (SELECT w.* FROM w JOIN mk ON mk.target_id = w.target_id AND mk.op <> 'delete'
          WHERE w.operation <> 'delete' AND (mk.gone IS NULL OR (w.us, w.event_id) > mk.gone)),
{ctes},
net AS (SELECT n.target_id, n.op, n.gone IS NOT NULL AS reset, {', '.join(f'col_{c}.v AS v_{c}, col_{c}.target_id IS NOT NULL AS p_{c}' for c, _ in columns)}
        FROM mk n {joins})
SELECT coalesce(t.{key}, n.target_id) AS {key}, {', '.join(
        f"CASE WHEN n.p_{c} THEN n.v_{c} WHEN n.reset THEN NULL ELSE t.{c} END AS {c}" for c, _ in columns)}
       {{rest}}
FROM {target} t FULL OUTER JOIN net n ON n.target_id = t.{key}
WHERE n.op IS NULL OR n.op <> 'delete'"""


_B_COLUMNS = [("name", ""), ("email", ""), ("phone_number", ""), ("_legacy_is_active", ""), ("organization_id", "")]
_B_SOURCE = """
         nullif(trim(concat(coalesce(r.first_name, ''), ' ', coalesce(r.last_name, ''))), '') AS v_name, true AS p_name,
         coalesce(nullif(r.personal_email, ''), nullif(r.prefered_email, '')) AS v_email,
         coalesce(nullif(r.personal_email, ''), nullif(r.prefered_email, '')) IS NOT NULL AS p_email,
         r.cell_number AS v_phone_number, true AS p_phone_number, coalesce(r.ap_status = 'Active', false) AS v__legacy_is_active,
         true AS p__legacy_is_active, r.company AS v_organization_id, true AS p_organization_id"""


@query("apply_changes_b", _merge_sql("pa", "b_person", "id", _B_COLUMNS, _B_SOURCE).replace(
    "{rest}", ", CASE WHEN n.reset THEN NULL ELSE t.updated_at END AS updated_at"))
def apply_changes_b(t: Tables):
    """Side b's people after the batch: side a's events mapped, matched and merged."""
    return _batch(t, merge=True, specs=[presets.PERSON]).tables["users_Employee", A2B]


_A_COLUMNS = [("subject", ""), ("status", ""), ("act_start_date", ""), ("is_milestone", ""), ("modified", ""), ("description", "")]
_A_SOURCE = """
         coalesce(r.task_name, '') AS v_subject, true AS p_subject, coalesce(r.bt_status, '') AS v_status, true AS p_status,
         coalesce(split_part(r.start_date, 'T', 1), '') AS v_act_start_date, true AS p_act_start_date,
         cast(r.needs_submission AS int) AS v_is_milestone, true AS p_is_milestone, r.stamp AS v_modified, true AS p_modified,
         coalesce(r.page_content, '') AS v_description, true AS p_description"""


@query("apply_changes_a", _merge_sql("tb", "a_task", "name", _A_COLUMNS, _A_SOURCE).replace(
    "{rest}", ", CASE WHEN n.reset THEN NULL ELSE t.exp_start_date END AS exp_start_date,"
              " CASE WHEN n.reset THEN NULL ELSE t.organization_id END AS organization_id"))
def apply_changes_a(t: Tables):
    """Side a's tasks after the batch: side b's events mapped, matched and merged."""
    return _batch(t, merge=True, specs=[presets.TASK]).tables["tasks_Task", B2A]


@query("delete_outcomes", """
WITH dim AS (SELECT email, min(id) AS id FROM b_person GROUP BY email)
SELECT r.event_id, d.id IS NOT NULL AS deleted,
       CASE WHEN nullif(r.personal_email, '') IS NULL THEN 'no_email_for_lookup' WHEN d.id IS NULL THEN 'record_not_found' END AS reason
FROM event_records r LEFT JOIN dim d ON d.email = nullif(r.personal_email, '') WHERE r.operation = 'delete'""")
def delete_outcomes(t: Tables):
    from tablesync.functions.text import non_empty

    deletes = t("event_records").where("operation = 'delete'").select(
        "event_id", non_empty(F.col("personal_email")).alias("email")
    )
    found = match.first_by(t("b_person"), F.col("email"), "id")
    salted = F.coalesce(F.col("email"), F.concat(F.lit("\u0000"), F.col("event_id").cast("string")))
    rows = deletes.join(found, salted == F.col("_match"), "left")
    done, reason = ap.delete_outcome(F.col("email"), F.col("_target_id"), "no_email_for_lookup")
    return rows.select("event_id", done.alias("deleted"), reason.alias("reason"))
