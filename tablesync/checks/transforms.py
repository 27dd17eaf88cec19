"""Value transforms and dimension lookups."""

from pyspark.sql import functions as F

from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.functions import text
from tablesync.functions import transforms as tr
from tablesync.functions.transforms import Context, apply_transform
from tablesync.operators import lookups as lk
from tablesync.profiles import A2B, B2A, MappingSpec


def _apply(column, conf, direction, kind="string", row=None):
    ctx = Context(conf, direction, row or {}, {"x": kind}, "x")
    return apply_transform(F.col(column), ctx)


_NAMES = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE split_part(c_name, '#', 1) END AS first_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('N ', split_part(c_name, '#', 2)) END AS last_name
FROM customer"""


@query("name_combine", f"""
SELECT c_custkey, trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))) AS full_name FROM ({_NAMES}) n""")
def name_combine(t: Tables):
    names = t.sql(_NAMES)
    full = tr.combine_name(F.col("first_name"), F.col("last_name"))
    return names.select("c_custkey", full.alias("full_name"))


@query("name_split", """
SELECT doc_id, split_part(text, ' ', 1) AS first_name,
       CASE WHEN contains(text, ' ') THEN substring(text, strpos(text, ' ') + 1) ELSE '' END AS last_name
FROM documents""")
def name_split(t: Tables):
    first, last = tr.split_name(F.col("text"))
    return t("documents").select("doc_id", first.alias("first_name"), last.alias("last_name"))


@query("email_priority", """
SELECT name, coalesce(nullif(prefered_email, ''), nullif(personal_email, '')) AS email FROM a_person""")
def email_priority(t: Tables):
    people = t("a_person")
    conf = {"type": "email_priority", "email_priority": ["prefered_email", "personal_email"]}
    row = {c: F.col(c) for c in people.columns}
    return people.select("name", _apply("name", conf, A2B, row=row).alias("email"))


@query("email_fanout", """
SELECT id, email AS personal_email, email AS prefered_email FROM b_person""")
def email_fanout(t: Tables):
    fields = ["personal_email", "prefered_email"]
    return t("b_person").select("id", *tr.fan_out(F.col("email"), fields))


@query("status_map", """
SELECT o_orderkey, o_orderstatus = 'O' AS is_active,
       CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE 'O' END AS status FROM orders""")
def status_map(t: Tables):
    conf = {"type": "status_mapping", "active_status": "O", "inactive_status": "X"}
    rows = t("orders").withColumn("flag", F.col("o_orderkey") % 3 != 0)
    return rows.select(
        "o_orderkey",
        _apply("o_orderstatus", conf, A2B).alias("is_active"),
        _apply("flag", conf, B2A, "boolean").alias("status"),
    )


_WORD = "split_part('Active,Inactive,1,0,true,FALSE,later,', ',', cast(1 + l_orderkey % 8 AS int))"


@query("boolean_map", f"""
SELECT l_orderkey, l_linenumber, w <> '' AND lower(w) NOT IN ('inactive', '0', 'false') AS generic,
       w <> '' AS milestone, l_linenumber % 2 <> 0 AS from_number,
       CASE WHEN l_linenumber % 2 <> 0 THEN 1 ELSE 0 END AS to_number
FROM (SELECT *, {_WORD} AS w FROM lineitem) l""")
def boolean_map(t: Tables):
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.expr(_WORD).alias("w"), (F.col("l_linenumber") % 2).alias("n")
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        _apply("w", {"type": "boolean"}, A2B).alias("generic"),
        _apply("w", {"type": "is_milestone_to_needs_submission"}, A2B).alias("milestone"),
        _apply("n", {"type": "is_milestone_to_needs_submission"}, A2B, "integer").alias("from_number"),
        _apply("n", {"type": "needs_submission_to_is_milestone"}, B2A, "integer").alias("to_number"),
    )


@query("value_map", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '5-LOW' THEN 'L' ELSE o_orderpriority END AS priority
FROM orders""")
def value_map(t: Tables):
    conf = {"type": "value_map", "mappings": {"1-URGENT": "U", "5-LOW": "L"}}
    return t("orders").select("o_orderkey", _apply("o_orderpriority", conf, A2B).alias("priority"))


_LOOKUP_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, {value} AS supplier
FROM lineitem l LEFT JOIN (SELECT s_suppkey, min(s_name) AS s_name FROM supplier GROUP BY s_suppkey) s
  ON s.s_suppkey = l.l_partkey"""


@query("lookup_dim", _LOOKUP_SQL.format(value="coalesce(s.s_name, cast(l.l_partkey AS string))"))
def lookup_dim(t: Tables):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tr.lookup(rows, "l_partkey", t("supplier"), "s_suppkey", "s_name", output="supplier")


@query("lookup_dim_strict", _LOOKUP_SQL.format(value="s.s_name"))
def lookup_dim_strict(t: Tables):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tr.lookup(
        rows, "l_partkey", t("supplier"), "s_suppkey", "s_name", output="supplier", strict=True
    )


_CODES = """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('PROJ-', n) WHEN 1 THEN 'PROJ-x' WHEN 2 THEN ''
            WHEN 3 THEN 'ABC' WHEN 4 THEN concat('TASK-2025-', n) ELSE 'TASK-2025' END AS code
FROM (SELECT o_orderkey, right(concat('0000', cast(o_custkey AS string)), 4) AS n FROM orders) o"""


@query("id_decode", f"""
SELECT o_orderkey,
       CASE WHEN code LIKE 'PROJ-%' THEN cast(try_cast(split_part(code, '-', 2) AS bigint) AS string)
            ELSE nullif(code, '') END AS as_int,
       CASE WHEN code LIKE 'PROJ-%' THEN coalesce(cast(try_cast(replace(code, 'PROJ-', '') AS bigint) AS string), code)
            ELSE code END AS project,
       CASE WHEN code LIKE 'TASK-%' THEN coalesce(cast(try_cast(split_part(code, '-', 3) AS bigint) AS string), code)
            ELSE code END AS task
FROM ({_CODES}) c""")
def id_decode(t: Tables):
    code = F.col("code")
    return t.sql(_CODES).select(
        "o_orderkey",
        _apply("code", {"type": "string_to_int"}, A2B).alias("as_int"),
        tr.decode_project_id(code).alias("project"),
        tr.decode_task_id(code).alias("task"),
    )


@query("id_encode", """
SELECT o_orderkey, CASE WHEN o_custkey <> 0 THEN printf('PROJ-%04d', o_custkey) END AS project4,
       printf('PROJ-%03d', o_custkey) AS project3, printf('TASK-2025-%04d', o_custkey) AS task FROM orders""")
def id_encode(t: Tables):
    return t("orders").select(
        "o_orderkey",
        _apply("o_custkey", {"type": "string_to_int"}, B2A, "long").alias("project4"),
        tr.encode_project_id(F.col("o_custkey")).alias("project3"),
        tr.encode_task_id(F.col("o_custkey"), 2025).alias("task"),
    )


@query("prefix_transform", f"""
SELECT o_orderkey, CASE WHEN code LIKE 'TASK%' THEN
         coalesce(cast(try_cast(replace(replace(code, 'TASK', ''), '-', '') AS bigint) AS string), code)
         ELSE code END AS stripped,
       printf('TASK-2025-%04d', o_orderkey) AS built
FROM ({_CODES}) c""")
def prefix_transform(t: Tables):
    conf = {"type": "prefix_transform", "prefix": "TASK", "year": 2025}
    return t.sql(_CODES).select(
        "o_orderkey",
        _apply("code", conf, A2B).alias("stripped"),
        _apply("o_orderkey", conf, B2A, "long").alias("built"),
    )


_ARRAYS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '[]' WHEN o_orderkey % 11 = 0 THEN 'none'
            ELSE concat('[''', cast(o_custkey AS string), ''', ''-1'', "', cast(o_orderkey AS string), '"]') END AS items
FROM orders"""


@query("array_lookup", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE concat(coalesce(c.c_name, cast(o_custkey AS string)), ',-1,', coalesce(d.c_name, cast(o_orderkey AS string))) END AS names
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer d ON d.c_custkey = o_orderkey""")
def array_lookup(t: Tables):
    rows = t.sql(_ARRAYS)
    parsed = rows.select(
        "o_orderkey", _apply("items", {"type": "array_to_uuid_array"}, A2B).alias("names")
    )
    out = tr.lookup_elements(parsed, "o_orderkey", "names", t("customer"), "c_custkey", "c_name")
    return out.withColumn("names", F.array_join("names", ","))


@query("date_fallback", """
SELECT name, coalesce(act_start_date, exp_start_date) AS start_date FROM a_task""")
def date_fallback(t: Tables):
    tasks = t("a_task")
    conf = {
        "type": "date_fallback",
        "primary_field": "act_start_date",
        "fallback_field": "exp_start_date",
    }
    row = {c: F.col(c) for c in tasks.columns}
    return tasks.select("name", _apply("act_start_date", conf, A2B, row=row).alias("start_date"))


@query("default_values", """
SELECT name, 'Male' AS gender, coalesce(organization_id, 'org') AS organization_id FROM a_task""")
def default_values(t: Tables):
    return t("a_task").select(
        "name",
        _apply("status", {"type": "default_value", "value": "Male"}, B2A).alias("gender"),
        _apply(
            "organization_id", {"type": "default_value", "value": "org", "mode": "if_absent"}, A2B
        ).alias("organization_id"),
    )


@query("iso_to_date", """
SELECT id, split_part(start_date, 'T', 1) AS day, split_part(task_name, 'T', 1) AS kept FROM b_task""")
def iso_to_date(t: Tables):
    conf = {
        "type": "date_format_conversion",
        "input_format": "iso_datetime",
        "output_format": "date_string",
    }
    return t("b_task").select(
        "id",
        _apply("start_date", conf, B2A).alias("day"),
        _apply("task_name", conf, B2A).alias("kept"),
    )


@query("labels", r"""
SELECT p_partkey, array_to_string([concat(upper(substring(x, 1, 1)), lower(substring(x, 2)))
         for x in regexp_extract_all(replace(name, '_', ' '), '([a-zA-Z]+|[^a-zA-Z]+)')], '') AS label
FROM (SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_2nd-', p_type, '_', p_brand, 'x') AS name FROM part) p""")
def labels(t: Tables):
    rows = t.sql(
        "SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_2nd-', p_type, '_', p_brand, 'x') AS name FROM part"
    )
    return rows.select("p_partkey", text.field_label(F.col("name")).alias("label"))


LINES = MappingSpec(
    "lines", "Line", "sessions",
    {"name": "code", "instructor": "instructor", "project": "project", "owner": "owner", "items": "items"},
    {"code": "name", "instructor": "instructor", "project": "project", "items": "items"},
    derive_a2b={
        "instructor": {"type": "lookup", "b_table": "suppliers", "a_field": "key", "b_field": "label"},
        "project": {"type": "project_lookup", "a_field": "label", "b_field": "key"},
        "owner": {"type": "task_project", "b_table": "projects", "a_field": "label", "b_field": "key"},
        "items": {"type": "array_to_uuid_array", "b_table": "suppliers", "a_field": "key", "b_field": "label"},
    },
    derive_b2a={
        "instructor": {"type": "lookup", "a_type": "suppliers", "a_field": "key", "b_field": "label"},
        "project": {"type": "project_lookup", "a_field": "label", "b_field": "key"},
        "items": {"type": "uuid_array_to_array", "a_type": "suppliers", "a_field": "key", "b_field": "label"},
    },
)
_DIMS = {
    "suppliers": "SELECT cast(s_suppkey AS string) AS key, s_name AS label FROM supplier",
    "projects": "SELECT cast(p_partkey AS string) AS key, concat('PROJ-', p_name) AS label FROM part WHERE p_partkey % 2 = 0",
}
_LINES_A = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS name, cast(l_partkey AS string) AS instructor,
       CASE WHEN l_linenumber = 1 THEN '' ELSE concat('PROJ-', p_name) END AS project,
       CASE WHEN l_linenumber = 2 THEN concat('PROJ-', p_name) WHEN l_linenumber = 3 THEN 'PROJ-007'
            ELSE cast(l_suppkey AS string) END AS owner,
       concat('[', chr(39), cast(l_suppkey AS string), chr(39), ', ', chr(39), 'x', chr(39), ', "', cast(l_partkey AS string), '"]') AS items
FROM lineitem JOIN part ON p_partkey = l_partkey"""
_LINES_B = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS code,
       CASE WHEN l_linenumber = 1 THEN 'nobody' ELSE s_name END AS instructor, cast(l_partkey AS string) AS project,
       concat('["', s_name, '", "x"]') AS items
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""
_S = "(SELECT key, min(label) AS label FROM suppliers GROUP BY key)"
_SL = "(SELECT label, min(key) AS key FROM suppliers GROUP BY label)"
_P = "(SELECT key, min(label) AS label FROM projects GROUP BY key)"
_PL = "(SELECT label, min(key) AS key FROM projects GROUP BY label)"


@query("map_with_lookups", f"""
WITH suppliers AS ({_DIMS["suppliers"]}), projects AS ({_DIMS["projects"]}), a AS ({_LINES_A}), b AS ({_LINES_B})
SELECT 'a2b' AS way, a.name AS code, coalesce(s.label, a.instructor) AS instructor, p.key AS project, project <> '' AND p.key IS NOT NULL AS has_project,
       CASE WHEN a.owner = 'PROJ-007' THEN '7' ELSE coalesce(o.key, a.owner) END AS owner,
       concat(coalesce(x.label, split_part(items, chr(39), 2)), ',x,', coalesce(y.label, a.instructor)) AS items
FROM a LEFT JOIN {_S} s ON s.key = a.instructor LEFT JOIN {_PL} p ON p.label = a.project
LEFT JOIN {_PL} o ON o.label = a.owner
LEFT JOIN {_S} x ON x.key = split_part(items, chr(39), 2) LEFT JOIN {_S} y ON y.key = a.instructor
UNION ALL
SELECT 'b2a', b.code, coalesce(s.key, b.instructor), coalesce(p.label, b.project), true, NULL,
       concat(coalesce(x.key, split_part(items, '"', 2)), ',x')
FROM b LEFT JOIN {_SL} s ON s.label = b.instructor LEFT JOIN {_P} p ON p.key = b.project
LEFT JOIN {_SL} x ON x.label = split_part(items, '"', 2)""")
def map_with_lookups(t: Tables):
    """Lookups named by a mapping, both ways: a value, a project, a project's name, and elements."""
    dims = {name: t.sql(sql) for name, sql in _DIMS.items()}
    dims["Project"] = dims["projects"]
    there = lk.map_with_lookups(t.sql(_LINES_A), LINES, A2B, dims, "name")
    back = lk.map_with_lookups(t.sql(_LINES_B), LINES, B2A, dims, "code")
    a2b = there.select(
        F.lit("a2b").alias("way"), "code", "instructor", "project",
        F.array_contains("_present", "project").alias("has_project"), "owner", F.array_join("items", ",").alias("items"),
    )
    return a2b.unionByName(back.select(
        F.lit("b2a").alias("way"), F.col("name").alias("code"), "instructor", "project",
        F.array_contains("_present", "project").alias("has_project"), F.lit(None).cast("string").alias("owner"),
        F.array_join("items", ",").alias("items"),
    ))
