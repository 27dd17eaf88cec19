"""Record mapping: whole tables to the other side's shape, and the rendering rules."""

from pyspark.sql import functions as F

from tablesync import presets
from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.functions import render
from tablesync.operators import mapping as m
from tablesync.profiles import A2B, B2A

COMPANIES = {
    "BUILDING": "dd9d4bc8",
    "MACHINERY": "0ca0f05e",
}
PERSON = presets.with_companies(presets.PERSON, COMPANIES)
PROJECT = presets.with_companies(
    presets.PROJECT, {"Brand#1": "dd9d4bc8", "Brand#2": "0ca0f05e"}
)


def _flat(df):
    """Arrays as text, so that both engines compare them alike."""
    return df.withColumn(m.PRESENT, F.array_join(m.PRESENT, ",")).withColumn(
        m.ERRORS, F.array_join(m.ERRORS, ",")
    )


@query("map_task_a2b", f"""
SELECT name AS _name, nullif(subject, '') AS task_name, nullif(status, '') AS status,
       coalesce(act_start_date, exp_start_date) AS start_date, is_milestone AS needs_submission,
       replace(modified, ' ', 'T') AS updated_at, nullif(description, '') AS page_content,
       coalesce(organization_id, '{presets.ORGANIZATION_ID}') AS organization_id,
       'task_name,status,start_date,needs_submission,updated_at,page_content,organization_id' AS _present,
       '' AS _errors
FROM a_task""")
def map_task_a2b(t: Tables):
    return _flat(m.map_records(t("a_task"), presets.TASK, A2B, keep=("name",)))


@query("map_task_b2a", """
SELECT id AS _id, coalesce(task_name, '') AS subject, coalesce(status, '') AS status,
       coalesce(split_part(start_date, 'T', 1), '') AS act_start_date, needs_submission AS is_milestone,
       replace(replace(updated_at, 'T', ' '), 'Z', '') AS modified, coalesce(page_content, '') AS description,
       'subject,status,act_start_date,is_milestone,modified,description' AS _present, '' AS _errors
FROM b_task""")
def map_task_b2a(t: Tables):
    return _flat(m.map_records(t("b_task"), presets.TASK, B2A, keep=("id",)))


_PERSON_A2B = """
SELECT name AS _name, concat(first_name, ' ', last_name) AS name,
       coalesce(nullif(personal_email, ''), nullif(prefered_email, '')) AS email,
       nullif(cell_number, '') AS phone_number, status = 'Active' AS _legacy_is_active,
       CASE company WHEN 'BUILDING' THEN 'dd9d4bc8' WHEN 'MACHINERY' THEN '0ca0f05e' ELSE company END AS organization_id,
       concat('name,', CASE WHEN coalesce(nullif(personal_email, ''), nullif(prefered_email, '')) IS NULL THEN ''
                            ELSE 'email,' END, 'phone_number,_legacy_is_active,organization_id') AS _present,
       '' AS _errors
FROM a_person"""


@query("map_person_a2b", _PERSON_A2B)
def map_person_a2b(t: Tables):
    return _flat(m.map_records(t("a_person"), PERSON, A2B, keep=("name",)))


@query("map_person_b2a", """
SELECT id AS _id, split_part(name, ' ', 1) AS first_name,
       CASE WHEN contains(name, ' ') THEN substring(name, strpos(name, ' ') + 1) ELSE '' END AS last_name,
       coalesce(email, '') AS personal_email, coalesce(phone_number, '') AS cell_number,
       CASE WHEN _legacy_is_active THEN 'Active' ELSE 'Inactive' END AS status,
       CASE organization_id WHEN 'dd9d4bc8' THEN 'BUILDING' WHEN '0ca0f05e' THEN 'MACHINERY'
            ELSE organization_id END AS company,
       'Male' AS gender, '1990-01-01' AS date_of_birth, '2025-01-01' AS date_of_joining,
       'first_name,personal_email,cell_number,status,company,last_name,gender,date_of_birth,date_of_joining' AS _present,
       '' AS _errors
FROM b_person""")
def map_person_b2a(t: Tables):
    return _flat(m.map_records(t("b_person"), PERSON, B2A, keep=("id",)))


def _uuid_sql(text: str) -> str:
    h = f"sha256({text})"
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substring({h}, {s}, {n})" for s, n in parts) + ")"


@query("map_project_a2b", f"""
SELECT {_uuid_sql("concat('Project/', name)")} AS id, project_name AS name, status, is_active,
       CASE company WHEN 'Brand#1' THEN 'dd9d4bc8' WHEN 'Brand#2' THEN '0ca0f05e' ELSE company END AS organization_id,
       nullif(priority, '') AS priority, percent_complete AS progress,
       'id,name,status,is_active,organization_id,priority,progress' AS _present, '' AS _errors
FROM a_project""")
def map_project_a2b(t: Tables):
    return _flat(m.map_records(t("a_project"), PROJECT, A2B))


@query("map_training_a2b", f"""
SELECT {_uuid_sql("concat('Training Event/', name)")} AS id, event_name AS event_title, event_type,
       start_time AS start_date, status, instructor, max_participants, participants,
       nullif(company, '') AS organization_id, replace(modified, ' ', 'T') AS updated_at,
       'id,event_title,event_type,start_date,status,instructor,max_participants,participants,organization_id,updated_at' AS _present,
       '' AS _errors
FROM a_training""")
def map_training_a2b(t: Tables):
    return _flat(m.map_records(t("a_training"), presets.TRAINING, A2B))


@query("surrogate_key", f"""
SELECT o_orderkey, {_uuid_sql("concat('Task/', cast(o_orderkey AS string))")} AS id FROM orders""")
def surrogate_key(t: Tables):
    return t("orders").select("o_orderkey", m.surrogate_key("Task", F.col("o_orderkey")).alias("id"))


_STAMPS = """
SELECT event_id,
       CASE event_id % 8 WHEN 0 THEN s WHEN 1 THEN concat(replace(s, ' ', 'T'), 'Z')
            WHEN 2 THEN concat(s, '.250000') WHEN 3 THEN concat(replace(s, ' ', 'T'), '.5+05:30')
            WHEN 4 THEN substring(s, 1, 10) WHEN 5 THEN concat('at ', s) WHEN 6 THEN '2025-02-31 10:00:00' ELSE '' END AS stamp
FROM (SELECT event_id, substring(cast(ts AS string), 1, 19) AS s FROM events) e"""


@query("render_timestamps", f"""
WITH stamps AS ({_STAMPS})
SELECT event_id,
       CASE event_id % 8 WHEN 0 THEN replace(stamp, ' ', 'T') WHEN 1 THEN replace(stamp, 'Z', '+00:00')
            WHEN 2 THEN replace(stamp, ' ', 'T') WHEN 3 THEN replace(stamp, '.5+', '.500000+')
            WHEN 4 THEN concat(stamp, 'T00:00:00') ELSE stamp END AS for_b,
       CASE event_id % 8 WHEN 0 THEN stamp WHEN 1 THEN replace(substring(stamp, 1, 19), 'T', ' ')
            WHEN 2 THEN substring(stamp, 1, 19) WHEN 3 THEN replace(substring(stamp, 1, 19), 'T', ' ')
            WHEN 4 THEN concat(stamp, ' 00:00:00') ELSE stamp END AS for_a
FROM stamps""")
def render_timestamps(t: Tables):
    stamp = F.col("stamp")
    return t.sql(_STAMPS).select(
        "event_id",
        render.render_timestamp(stamp, iso=True).alias("for_b"),
        render.render_timestamp(stamp, iso=False).alias("for_a"),
    )


_WORDS = """split_part('true,1,Yes,ON,active,False,0,No,off,INACTIVE,maybe,', ',', cast(1 + o_orderkey % 12 AS int))"""


@query("coerce_booleans", f"""
SELECT o_orderkey, CASE WHEN lower(w) IN ('true', '1', 'yes', 'on', 'active') THEN true
                        WHEN lower(w) IN ('false', '0', 'no', 'off', 'inactive') THEN false END AS enabled,
       CASE WHEN w = 'maybe' THEN 'enabled: not a boolean' ELSE '' END AS _errors
FROM (SELECT o_orderkey, {_WORDS} AS w FROM orders) o""")
def coerce_booleans(t: Tables):
    words = t.sql(f"SELECT o_orderkey, {_WORDS} AS enabled FROM orders")
    spec = presets.MappingSpec.simple("Flag", "flags", {"o_orderkey": "o_orderkey", "enabled": "enabled"})
    return _flat(m.map_records(words, spec, A2B)).drop(m.PRESENT)


@query("null_policy", """
SELECT name, nullif(personal_email, '') AS for_b, coalesce(personal_email, '') AS for_a FROM a_person""")
def null_policy(t: Tables):
    email = F.col("personal_email")
    return t("a_person").select(
        "name",
        render.null_policy(email, True).alias("for_b"),
        render.null_policy(email, False).alias("for_a"),
    )


@query("audit_columns", """
SELECT o_orderkey, '2025-03-01T08:30:00' AS updated_at,
       CASE WHEN o_orderkey % 3 = 0 THEN '2025-03-01T08:30:00' ELSE cast(o_orderkey AS string) END AS created_at
FROM orders""")
def audit_columns(t: Tables):
    rows = t.sql(
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderkey AS string) END AS created_at FROM orders"
    )
    return m.with_audit(rows, F.lit("2025-03-01 08:30:00").cast("timestamp"), "b")


@query("transform_alias", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('own', cast(c_custkey AS string)) ELSE c_name END AS id,
       c_name AS name FROM customer""")
def transform_alias(t: Tables):
    rows = t.sql(
        "SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('own', cast(c_custkey AS string)) END AS id,"
        " c_name AS name FROM customer"
    )
    return m.alias_id(rows, A2B)


@query("full_export", f"""
SELECT id, name, email, phone_number, _legacy_is_active, organization_id, updated_at FROM b_person
UNION ALL
SELECT {_uuid_sql("concat('Employee/', _name)")} AS id, name, email, phone_number, _legacy_is_active,
       organization_id, NULL AS updated_at FROM ({_PERSON_A2B}) p""")
def full_export(t: Tables):
    """One-shot copy of a whole table into the other side, without matching."""
    rows = m.map_records(t("a_person"), PERSON, A2B, keep=("name",))
    rows = rows.withColumn("id", m.surrogate_key("Employee", F.col("_name"))).drop(
        "_name", m.PRESENT, m.ERRORS
    )
    return t("b_person").unionByName(rows, allowMissingColumns=True)
