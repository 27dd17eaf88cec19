"""Schema catalogs, schema matching and the mapping table."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.operators import catalog as ct
from tablesync.operators import mapping_table as mtab
from tablesync.operators import schema_match as sm
from tablesync.session import stage


@query("catalog_a", """
SELECT tab AS "table", 1 AS ordinal, concat('f_', replace(p_name, ' ', '_')) AS fieldname, p_name AS label,
       CASE WHEN p_size % 2 = 0 THEN 'Int' ELSE 'Select' END AS fieldtype, p_type AS options, 0 AS reqd, p_size AS length, '' AS description
FROM metadata JOIN part ON concat(p_brand, ' ', cast(p_partkey AS string)) = tab
UNION ALL
SELECT tab AS "table", 0 AS ordinal, 'name' AS fieldname, 'Name' AS label, 'Data' AS fieldtype, NULL AS options, 1 AS reqd,
       NULL AS length, '' AS description FROM metadata""")
def catalog_a(t: Tables):
    rows = ct.catalog_from_metadata(t("metadata"), "tab", "fields", skip=("modified",))
    return rows.select(
        "table", "ordinal", "fieldname", "label", "fieldtype", "options", "reqd", "length", "description"
    )


_KINDS = {
    "BIGINT": "integer",
    "INTEGER": "integer",
    "DOUBLE": "numeric",
    "VARCHAR": "varchar",
    "TIMESTAMP": "timestamp",
    "FLOAT[]": "jsonb",
}
_PROFILED = {
    "customer": "c_custkey:BIGINT c_name:VARCHAR c_nationkey:INTEGER c_acctbal:DOUBLE c_mktsegment:VARCHAR",
    "documents": "doc_id:BIGINT text:VARCHAR lang:VARCHAR source:VARCHAR n_chars:BIGINT",
    "embeddings": "vec_id:BIGINT embedding:FLOAT[] label:INTEGER",
    "events": "event_id:BIGINT ts:TIMESTAMP user_id:BIGINT event_type:VARCHAR value:DOUBLE props:VARCHAR",
    "lineitem": "l_orderkey:BIGINT l_partkey:BIGINT l_suppkey:BIGINT l_linenumber:INTEGER l_quantity:DOUBLE "
    "l_extendedprice:DOUBLE l_discount:DOUBLE l_tax:DOUBLE l_returnflag:VARCHAR l_linestatus:VARCHAR l_shipdate:TIMESTAMP",
    "pages": "page_id:BIGINT url:VARCHAR html:VARCHAR",
}


def _profile_sql() -> str:
    parts = []
    for table, columns in _PROFILED.items():
        for n, column in enumerate(columns.split()):
            name, kind = column.split(":")
            text = kind == "VARCHAR"
            longest = f"max(length({name}))" if text else "NULL"
            shown = (
                f"CASE WHEN count({name}) = 0 OR max(length({name})) > 255 THEN 'text' ELSE 'varchar' END"
                if text
                else f"'{_KINDS[kind]}'"
            )
            parts.append(
                f"SELECT '{table}' AS \"table\", {n} AS ordinal, '{name}' AS fieldname, {shown} AS fieldtype,"
                f" count(*) AS n_rows, count(*) - count({name}) AS n_null, cast({longest} AS int) AS max_length FROM {table}"
            )
    return "\nUNION ALL ".join(parts)


def _profiles(t: Tables):
    return reduce(DataFrame.unionByName, [ct.profile(t(name), name) for name in _PROFILED])


@query("profile_columns", _profile_sql())
def profile_columns(t: Tables):
    return _profiles(t)


_LABEL_SQL = """array_to_string([concat(upper(substring(x, 1, 1)), lower(substring(x, 2)))
  for x in regexp_extract_all(replace(fieldname, '_', ' '), '([a-zA-Z]+|[^a-zA-Z]+)')], '')"""


@query("catalog_b", f"""
SELECT "table", ordinal, fieldname, {_LABEL_SQL} AS label, fieldtype, n_null > 0 AS nullable FROM ({_profile_sql()}) p""")
def catalog_b(t: Tables):
    return reduce(
        DataFrame.unionByName, [ct.catalog_from_table(t(name), name) for name in _PROFILED]
    )


@query("catalog_json", """
WITH p AS (SELECT source AS "table", r.* FROM (
  SELECT *, kind <> 'other' AND source = 'a' AND kind = 'person' AS pa, kind = 'person' AND source = 'b' AS pb,
         kind = 'task' AND source = 'a' AS ta, kind = 'task' AND source = 'b' AS tb, kind = 'other' AS ot FROM event_records) r)
SELECT "table", f AS fieldname, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS n_null,
       cast(max(length(v)) FILTER (WHERE k = 's') AS int) AS max_length,
       CASE WHEN bool_or(k = 's' AND v IS NOT NULL) THEN 'varchar' WHEN bool_or(k = 'i' AND v IS NOT NULL) THEN 'integer'
            WHEN bool_or(k = 'b' AND v IS NOT NULL) THEN 'boolean' ELSE 'text' END AS fieldtype
FROM (
""" + "\nUNION ALL ".join(
    f"""SELECT "table", '{f}' AS f, cast({v} AS string) AS v, '{k}' AS k FROM p WHERE {w}"""
    for w, fields in {
        "pa": "name:ap_name:s first_name:first_name:s last_name:last_name:s cell_number:cell_number:s personal_email:personal_email:s "
              "prefered_email:prefered_email:s company:company:s status:ap_status:s modified:stamp:s",
        "pb": "id:bp_id:s name:bp_name:s email:email:s phone_number:phone_number:s _legacy_is_active:bp_active:b "
              "organization_id:bp_org:s updated_at:concat(stamp,'Z'):s",
        "ta": "name:at_name:s subject:subject:s status:at_status:s act_start_date:act_start_date:s exp_start_date:exp_start_date:s "
              "description:description:s is_milestone:is_milestone:i organization_id:at_org:s modified:stamp:s",
        "tb": "id:bt_id:s task_name:task_name:s status:bt_status:s start_date:start_date:s page_content:page_content:s "
              "needs_submission:needs_submission:b updated_at:concat(stamp,'Z'):s",
        "ot": "name:concat('INV-',user_id):s",
    }.items() for f, v, k in (x.split(":") for x in fields.split())
) + """
) u GROUP BY "table", f""")
def catalog_json(t: Tables):
    """Catalog of the landed JSON records: field types over every record, not a sample."""
    rows = ct.catalog_from_json(t("landed_events"), "data", F.col("source"))
    return rows.select("table", "fieldname", "n_rows", "n_null", "max_length", "fieldtype")


@query("type_compat", """
SELECT p_partkey, a_type, b_type, cast(CASE
  WHEN (a_type IN ('Data', 'Text', 'Code', 'Link', 'Select') AND b_type IN ('text', 'varchar')) OR (a_type = 'Long Text' AND b_type = 'text')
    OR (a_type = 'Int' AND b_type IN ('integer', 'bigint')) OR (a_type = 'Float' AND b_type IN ('numeric', 'real', 'double precision'))
    OR (a_type = 'Check' AND b_type = 'boolean') OR (a_type = 'Date' AND b_type = 'date')
    OR (a_type = 'Datetime' AND b_type IN ('timestamp', 'timestamptz')) OR (a_type = 'Time' AND b_type = 'time')
    OR (a_type = 'Currency' AND b_type IN ('numeric', 'money')) OR (a_type = 'Percent' AND b_type = 'numeric') THEN 1.0
  WHEN (a_type = 'Datetime' AND contains(b_type, 'timestamp')) OR (a_type = 'Time' AND contains(b_type, 'time'))
    OR (a_type = 'Date' AND contains(b_type, 'date')) THEN 0.8
  ELSE 0.0 END AS double) AS score FROM typed_fields""")
def type_compat(t: Tables):
    score = ct.type_score(F.col("a_type"), F.col("b_type"))
    return t("typed_fields").select("p_partkey", "a_type", "b_type", score.alias("score"))


@query("translate_types", """
SELECT p_partkey, b, CASE b WHEN 'integer' THEN 'bigint' WHEN 'numeric' THEN 'decimal(38,9)' WHEN 'boolean' THEN 'boolean'
            WHEN 'date' THEN 'date' WHEN 'timestamp' THEN 'timestamp' WHEN 'time' THEN 'string' WHEN 'text' THEN 'string' END AS spark
FROM (SELECT p_partkey, CASE WHEN a_type IN ('Int', 'Duration') THEN 'integer' WHEN a_type IN ('Float', 'Currency', 'Percent') THEN 'numeric'
             WHEN a_type = 'Check' THEN 'boolean' WHEN a_type = 'Date' THEN 'date' WHEN a_type = 'Datetime' THEN 'timestamp'
             WHEN a_type = 'Time' THEN 'time' WHEN a_type = 'Unknown' THEN NULL ELSE 'text' END AS b FROM typed_fields) t""")
def translate_types(t: Tables):
    b = ct.translate_type(F.col("a_type"))
    return t("typed_fields").select("p_partkey", b.alias("b"), ct.spark_type(b).alias("spark"))


# --- schema matching: catalogs whose names are made from the rows of the parts --------


def _block(x: str, y: str) -> str:
    """SQL: 1000 x length - start of the longest common part, the first in x of equals; or 0."""
    return (
        f"coalesce(list_max(flatten([[k * 1000 - i for k in range(1, len({x}) - i + 2) if contains({y}, {x}[i:i + k - 1])]"
        f" for i in range(1, len({x}) + 1)])), 0)"
    )


# Ratios of all pairs (l, r) of `pairs`: the longest common part, then the same left and right of it.
_RATIO = f"""
seg(l, r, x, y) AS (
  SELECT l, r, l, r FROM pairs
  UNION ALL
  SELECT l, r, CASE side WHEN 0 THEN x[1:i - 1] ELSE x[i + k:] END, CASE side WHEN 0 THEN y[1:j - 1] ELSE y[j + k:] END
  FROM (SELECT *, instr(y, x[i:i + k - 1]) AS j, unnest([0, 1]) AS side
        FROM (SELECT *, (code + 999) // 1000 AS k, (code + 999) // 1000 * 1000 - code AS i
              FROM (SELECT *, {_block("x", "y")} AS code FROM seg WHERE x <> '' AND y <> '') c WHERE code > 0) d) e),
ratio AS (
  SELECT l, r, CASE WHEN l = '' AND r = '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * m / (length(l) + length(r)) END AS ratio
  FROM (SELECT l, r, sum(({_block("x", "y")} + 999) // 1000)::DOUBLE AS m FROM seg GROUP BY l, r) s)"""

_PLAIN = "replace(lower(tab), '_', '')"
_TABLES = f"""
WITH RECURSIVE ta AS (SELECT DISTINCT tab, {_PLAIN} AS n FROM fields_a), tb AS (SELECT DISTINCT tab, {_PLAIN} AS n FROM fields_b),
fa AS (SELECT tab, ordinal, fieldname, lower(fieldname) AS n, lower(label) AS t, fieldtype FROM fields_a),
fb AS (SELECT tab, ordinal, fieldname, lower(fieldname) AS n, lower(label) AS t, fieldtype FROM fields_b),
pairs AS (SELECT DISTINCT ta.n AS l, tb.n AS r FROM ta, tb
  UNION SELECT x.n, y.n FROM (SELECT DISTINCT n FROM fa) x, (SELECT DISTINCT n FROM fb) y
  UNION SELECT x.t, y.t FROM (SELECT DISTINCT t FROM fa) x, (SELECT DISTINCT t FROM fb) y),
{_RATIO},
scored AS (SELECT ta.tab AS a_table, tb.tab AS b_table, CASE WHEN l = r THEN 1.0
    WHEN contains(l, r) OR contains(r, l) THEN greatest(ratio, {sm.CONTAINED_SCORE}) ELSE ratio END AS score
  FROM ratio JOIN ta ON ta.n = l JOIN tb ON tb.n = r),
tables AS (SELECT a_table, b_table, score FROM (SELECT *, row_number() OVER (PARTITION BY a_table ORDER BY score DESC, b_table) AS pick
    FROM scored) s WHERE pick = 1 AND score > {sm.TABLE_THRESHOLD})"""
_FIELDS = f"""{_TABLES},
kinds AS (SELECT a.*, b.tab AS b_tab, b.ordinal AS b_ordinal, b.fieldname AS b_field, b.n AS b_n, b.t AS b_t, cast(CASE
    WHEN (a.fieldtype = 'Data' AND b.fieldtype IN ('text', 'varchar')) OR (a.fieldtype = 'Int' AND b.fieldtype IN ('integer', 'bigint'))
      OR (a.fieldtype = 'Float' AND b.fieldtype IN ('numeric', 'real', 'double precision')) OR (a.fieldtype = 'Date' AND b.fieldtype = 'date') THEN 1.0
    WHEN a.fieldtype = 'Date' AND contains(b.fieldtype, 'date') THEN 0.8 ELSE 0.0 END AS double) AS kind
  FROM fa a JOIN tables p ON p.a_table = a.tab JOIN fb b ON b.tab = p.b_table),
fits AS (SELECT tab, ordinal, fieldname, b_field, b_ordinal,
    {sm.NAME_WEIGHT}::DOUBLE * n.ratio + {sm.TYPE_WEIGHT}::DOUBLE * kind + {sm.LABEL_WEIGHT}::DOUBLE * t.ratio AS score
  FROM kinds k JOIN ratio n ON n.l = k.n AND n.r = k.b_n JOIN ratio t ON t.l = k.t AND t.r = k.b_t),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tab, ordinal, fieldname ORDER BY score DESC, b_ordinal, b_field) AS pick
    FROM fits WHERE score > {sm.FIELD_THRESHOLD}) f WHERE pick = 1),
fields AS (SELECT a.tab AS a_table, p.b_table, a.ordinal, a.fieldname AS a_field, k.b_field, round(k.score, 6) AS score
  FROM fa a JOIN tables p ON p.a_table = a.tab
  LEFT JOIN picked k ON k.tab = a.tab AND k.ordinal = a.ordinal AND k.fieldname = a.fieldname)"""


def _catalogs(t: Tables):
    return [stage(t(name).withColumnRenamed("tab", "table"), name) for name in ("fields_a", "fields_b")]


def _fields(t: Tables):
    a, b = _catalogs(t)
    tables = stage(sm.match_tables(a, b), "matched-tables")
    return stage(sm.match_fields(a, b, tables), "matched-fields"), b, tables


@query("match_tables", f"{_TABLES} SELECT a_table, b_table, round(score, 6) AS score FROM tables")
def match_tables(t: Tables):
    return sm.match_tables(*_catalogs(t))


@query("match_fields", f"{_FIELDS} SELECT * FROM fields")
def match_fields(t: Tables):
    return _fields(t)[0]


@query("propose_mappings", f"""{_FIELDS},
hits AS (SELECT * FROM fields WHERE b_field IS NOT NULL),
pairs_of AS (SELECT a_table, b_table, CASE WHEN n > 0 THEN ((2 * micros + n) // (2 * n))::DOUBLE / 1000000 END AS field_score FROM (
  SELECT a_table, b_table, sum(round(score * 1000000)::BIGINT)::BIGINT AS micros, count(score) AS n FROM fields GROUP BY a_table, b_table) s)
SELECT concat_ws('_', p.a_table, p.b_table) AS name, p.a_table, p.b_table,
  coalesce((SELECT string_agg(concat(a_field, '=', b_field), ',' ORDER BY ordinal, a_field) FROM hits h
    WHERE h.a_table = p.a_table), '') AS forward,
  coalesce((SELECT string_agg(concat(b_field, '=', a_field), ',' ORDER BY b_field) FROM (SELECT a_table, b_field,
    arg_max(a_field, ordinal) AS a_field FROM hits GROUP BY a_table, b_field) h WHERE h.a_table = p.a_table), '') AS backward,
  CASE WHEN EXISTS (FROM hits h WHERE h.a_table = p.a_table) THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, field_score
FROM pairs_of p""")
def propose_mappings(t: Tables):
    found = sm.propose_mappings(_fields(t)[0])

    def shown(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")

    forward = F.transform(
        "sync_fields", lambda f: F.struct(f.alias("key"), F.try_element_at("field_mappings", f).alias("value"))
    )
    return found.select(
        "name", "a_table", "b_table", shown(forward).alias("forward"),
        shown(F.array_sort(F.map_entries("reverse_mappings"))).alias("backward"), "confidence", "field_score",
    )


@query("compare_schemas", f"""{_FIELDS}
SELECT a_table, b_table, a_field, b_field, score, CASE WHEN b_field IS NULL THEN 'only_a' ELSE 'mapped' END AS state FROM fields
UNION ALL
SELECT p.a_table, p.b_table, NULL, b.fieldname, NULL, 'only_b' FROM tables p JOIN fb b ON b.tab = p.b_table
WHERE NOT EXISTS (FROM fields f WHERE f.a_table = p.a_table AND f.b_table = p.b_table AND f.b_field = b.fieldname)""")
def compare_schemas(t: Tables):
    return sm.compare_schemas(*_fields(t))


@query("schema_summary", f"""
WITH p AS ({_profile_sql()}),
m AS (SELECT 'a' AS side, tab AS "table", unnest([1, 2, 3]) AS f FROM metadata
      UNION ALL SELECT 'b' AS side, "table", ordinal AS f FROM p)
SELECT side, "table", count(*) AS n_tables, cast(sum(n) AS bigint) AS n_fields
FROM (SELECT side, "table", count(*) AS n FROM m GROUP BY side, "table") c GROUP BY ROLLUP (side, "table")""")
def schema_summary(t: Tables):
    a = ct.catalog_from_metadata(t("metadata"), "tab", "fields")
    return ct.schema_summary(a, _profiles(t))


@query("event_tables", """
SELECT name FROM (SELECT concat(p_type, CASE p_partkey % 4 WHEN 0 THEN ' Event ' WHEN 1 THEN ' TRAINING ' ELSE ' item ' END,
                                cast(p_partkey AS string)) AS name FROM part) p
WHERE lower(name) LIKE '%event%' OR lower(name) LIKE '%training%'""")
def event_tables(t: Tables):
    names = t.sql(
        "SELECT concat(p_type, CASE p_partkey % 4 WHEN 0 THEN ' Event ' WHEN 1 THEN ' TRAINING ' ELSE ' item ' END,"
        " cast(p_partkey AS string)) AS name FROM part"
    )
    return ct.event_related(names, "name")


_HAS = """
SELECT p_partkey, name, p_size % 5 <> 0 AS has_a, p_size % 7 <> 0 AS has_b, p_partkey % 4 AS fm, p_partkey % 3 AS sf, p_partkey % 2 = 0 AS rv
FROM mapping_rows JOIN part ON concat('m', cast(p_partkey AS string)) = name"""


@query("validate_mappings", f"""
SELECT name,
       concat_ws(';', CASE WHEN NOT has_a THEN 'Missing required field: a_type' END, CASE WHEN NOT has_b THEN 'Missing required field: b_table' END,
                 CASE WHEN fm = 0 THEN 'Missing required field: field_mappings' END,
                 CASE WHEN fm IN (2, 3) THEN 'field_mappings must be a dictionary' END) AS mapper,
       concat_ws(';', CASE WHEN NOT has_a THEN 'Missing required field: a_type' END, CASE WHEN NOT has_b THEN 'Missing required field: b_table' END,
                 CASE WHEN fm = 0 THEN 'Missing required field: field_mappings' END,
                 CASE WHEN NOT rv THEN 'Missing required field: reverse_mappings' END) AS engine,
       concat_ws(';', CASE WHEN NOT has_a THEN 'Missing required field: a_type' END, CASE WHEN NOT has_b THEN 'Missing required field: b_table' END,
                 CASE WHEN sf = 0 THEN 'Missing required field: sync_fields' END) AS service,
       concat_ws(';', CASE WHEN NOT has_a THEN 'Missing required field: a_type' END, CASE WHEN NOT has_b THEN 'Missing required field: b_table' END,
                 CASE WHEN fm = 0 THEN 'Missing required field: field_mappings' END,
                 CASE WHEN fm IN (2, 3) THEN 'field_mappings must be a dictionary' END,
                 CASE WHEN sf = 2 THEN 'sync_fields must be a list' END) AS api
FROM ({_HAS}) h""")
def validate_mappings(t: Tables):
    conf = F.col("conf")
    return t("mapping_rows").select(
        "name",
        *[F.array_join(mtab.validation_errors(conf, p), ";").alias(p) for p in mtab.PROFILES],
    )


@query("mapping_upsert", """
WITH ch AS (SELECT concat('m', cast(s_suppkey * 30 AS string)) AS name, s_nationkey % 2 = 0 AS enabled, 'bidirectional' AS direction, s_name AS conf FROM supplier)
SELECT name, enabled, direction, conf FROM mapping_rows WHERE name NOT IN (SELECT name FROM ch)
UNION ALL SELECT name, enabled, direction, conf FROM ch""")
def mapping_upsert(t: Tables):
    changes = t("supplier").select(
        F.concat(F.lit("m"), F.col("s_suppkey") * 30).alias("name"),
        (F.col("s_nationkey") % 2 == 0).alias("enabled"),
        F.lit("bidirectional").alias("direction"),
        F.col("s_name").alias("conf"),
    )
    return mtab.upsert_mappings(t("mapping_rows"), changes)


@query("mapping_remove", """
WITH gone AS (SELECT DISTINCT concat('m', cast(s_suppkey * 30 AS string)) AS name FROM supplier)
SELECT name, 'kept' AS outcome FROM mapping_rows WHERE name NOT IN (SELECT name FROM gone)
UNION ALL
SELECT g.name, CASE WHEN m.name IS NULL THEN 'not_found' ELSE 'deleted' END AS outcome FROM gone g LEFT JOIN mapping_rows m ON m.name = g.name""")
def mapping_remove(t: Tables):
    names = t("supplier").select(F.concat(F.lit("m"), F.col("s_suppkey") * 30).alias("name"))
    kept = mtab.remove_mappings(t("mapping_rows"), names).select("name", F.lit("kept").alias("outcome"))
    return kept.unionByName(mtab.removal_report(t("mapping_rows"), names))
