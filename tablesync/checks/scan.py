"""Scans, point reads, upsert; events, routes and gates."""

from pyspark.sql import functions as F

from tablesync import presets
from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.operators import events as ev
from tablesync.operators import scan


@query("scan_eq", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def scan_eq(t: Tables):
    return scan.scan(
        t("orders"),
        {"o_orderstatus": "F", "o_orderpriority": "5-LOW"},
        ["o_orderkey", "o_custkey", "o_totalprice"],
    )


@query("scan_predicates", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_tax < 0.08
  AND l_linestatus <> 'O' AND l_returnflag IN ('A', 'R') AND l_returnflag LIKE '%A%'""")
def scan_predicates(t: Tables):
    return scan.scan(
        t("lineitem"),
        [
            ["l_quantity", ">", 10],
            ["l_quantity", "<=", 40],
            ["l_discount", ">=", 0.02],
            ["l_tax", "<", 0.08],
            ["l_linestatus", "!=", "O"],
            ["l_returnflag", "in", ["A", "R"]],
            ["l_returnflag", "like", "%A%"],
        ],
        ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"],
    )


@query("point_read", """
SELECT e.event_id, e.c_custkey, c.c_name, c.c_custkey IS NOT NULL AS found
FROM (SELECT event_id, user_id * 11 AS c_custkey FROM events) e
LEFT JOIN customer c ON c.c_custkey = e.c_custkey""")
def point_read(t: Tables):
    ids = t("events").select("event_id", (F.col("user_id") * 11).alias("c_custkey"))
    rows = scan.point_read(t("customer"), ids, "c_custkey")
    return rows.select("event_id", "c_custkey", "c_name", "found")


@query("lookup_by_field", """
SELECT l.l_orderkey, l.l_linenumber, d.target AS target_id
FROM (SELECT l_orderkey, l_linenumber, concat('Brand#', cast(l_quantity AS int)) AS brand FROM lineitem) l
LEFT JOIN (SELECT p_brand, min(p_partkey) AS target FROM part GROUP BY p_brand) d ON d.p_brand = l.brand""")
def lookup_by_field(t: Tables):
    rows = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("Brand#"), F.col("l_quantity").cast("int")).alias("brand"),
    )
    found = scan.lookup_by_field(rows, "brand", t("part"), "p_brand", "p_partkey")
    return found.select("l_orderkey", "l_linenumber", F.col("_target_id").alias("target_id"))


@query("search_ilike", """
SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the ')""")
def search_ilike(t: Tables):
    return scan.search(t("documents"), "text", "The ").select("doc_id", "source")


@query("count_filtered", """
SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000""")
def count_filtered(t: Tables):
    return scan.count_where(
        t("orders"), [["o_orderstatus", "=", "F"], ["o_totalprice", ">", 1000]]
    )


@query("upsert", """
SELECT coalesce(c.c_custkey, n.k) AS c_custkey,
       CASE WHEN n.k IS NOT NULL THEN n.name ELSE c.c_name END AS c_name,
       CASE WHEN n.k IS NOT NULL THEN n.seg ELSE c.c_mktsegment END AS c_mktsegment,
       c.c_nationkey
FROM customer c FULL OUTER JOIN
     (SELECT s_suppkey * 20 AS k, s_name AS name, concat('S', cast(s_nationkey AS string)) AS seg FROM supplier) n
  ON c.c_custkey = n.k""")
def upsert(t: Tables):
    changes = t("supplier").select(
        (F.col("s_suppkey") * 20).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.concat(F.lit("S"), F.col("s_nationkey")).alias("c_mktsegment"),
    )
    table = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return scan.upsert(table, changes, "c_custkey")


_A_LANDED = """
SELECT event_id,
       concat('{', CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"doctype":"Task",' ELSE '"doctype":"",' END,
              CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('"name":"HR-EMP-', cast(user_id AS string), '",')
                   WHEN 2 THEN concat('"name":"PROJ-', cast(user_id AS string), '",')
                   WHEN 3 THEN concat('"name":"TASK-', cast(user_id AS string), '",')
                   ELSE concat('"name":"X', cast(user_id AS string), '",') END,
              CASE WHEN event_id % 7 = 0 THEN '"employee":"E1",' ELSE '' END,
              CASE event_type WHEN 'signup' THEN '"operation":"after_insert",'
                   WHEN 'error' THEN '"operation":"after_delete",' WHEN 'click' THEN '"operation":"on_change",'
                   ELSE '' END, '"value":null}') AS payload
FROM events"""


@query("normalize_a_events", """
WITH p AS (
  SELECT event_id, event_id % 3 AS d, event_id % 5 AS n,
         CASE event_id % 5 WHEN 1 THEN concat('HR-EMP-', cast(user_id AS string))
              WHEN 2 THEN concat('PROJ-', cast(user_id AS string))
              WHEN 3 THEN concat('TASK-', cast(user_id AS string))
              WHEN 4 THEN concat('X', cast(user_id AS string)) END AS nm,
         CASE event_type WHEN 'signup' THEN 'after_insert' WHEN 'error' THEN 'after_delete'
              WHEN 'click' THEN 'on_change' ELSE 'after_update' END AS raw
  FROM events),
q AS (
  SELECT *, CASE WHEN d = 1 THEN 'Task' WHEN n = 2 THEN 'Project' WHEN n = 3 THEN 'Task' ELSE 'Employee' END AS entity,
         coalesce(nm, CASE WHEN event_id % 7 = 0 THEN 'E1' END, 'unknown') AS record_id FROM p)
SELECT event_id, concat('a_', entity, '_', record_id, '_', raw) AS id, entity, record_id,
       CASE raw WHEN 'after_insert' THEN 'create' WHEN 'after_delete' THEN 'delete' ELSE 'update' END AS operation,
       'a' AS original_source
FROM q""")
def normalize_a_events(t: Tables):
    return ev.normalize_a(t.sql(_A_LANDED)).select(
        "event_id", "id", "entity", "record_id", "operation", "original_source"
    )


_B_LANDED = """
SELECT event_id,
       concat('{"type":"', CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                                WHEN 'click' THEN 'TRUNCATE' ELSE 'UPDATE' END,
              '","table":"', CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'tasks' END, '",',
              CASE WHEN event_type = 'error' THEN '"record":null,"old_record"' ELSE '"record"' END,
              ':{"id":', cast(user_id AS string), ',"note":null}}') AS payload
FROM events"""


@query("normalize_b_events", """
SELECT event_id,
       concat('b_', CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'tasks' END, '_', cast(user_id AS string), '_',
              CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                   WHEN 'click' THEN 'TRUNCATE' ELSE 'UPDATE' END) AS id,
       CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'tasks' END AS entity,
       cast(user_id AS string) AS record_id,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
       'b' AS original_source, 'id,note' AS present
FROM events""")
def normalize_b_events(t: Tables):
    return ev.normalize_b(t.sql(_B_LANDED)).select(
        "event_id", "id", "entity", "record_id", "operation", "original_source",
        F.array_join("_present", ",").alias("present"),
    )


@query("snapshot_diff", """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
n AS (SELECT o_orderkey + cast(floor(o_orderkey / 3.0) AS bigint) AS k,
             CASE WHEN o_orderkey < 100 THEN o_orderstatus ELSE 'F' END AS status, o_orderpriority AS priority FROM orders)
SELECT coalesce(o.k, n.k) AS k,
       CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS operation,
       CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN
         concat_ws(',', CASE WHEN o.status <> n.status THEN 'status' END,
                        CASE WHEN o.priority <> n.priority THEN 'priority' END) END AS changed,
       n.status, n.priority
FROM o FULL OUTER JOIN n ON o.k = n.k
WHERE o.k IS NULL OR n.k IS NULL OR o.status <> n.status OR o.priority <> n.priority""")
def snapshot_diff(t: Tables):
    orders = t("orders")
    old = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    key = F.col("o_orderkey")
    new = orders.select(
        (key + F.expr("o_orderkey div 3")).alias("k"),
        F.when(key < 100, F.col("o_orderstatus")).otherwise("F").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    diff = ev.snapshot_diff(old, new, "k")
    return diff.withColumn("changed", F.array_join("changed", ","))


@query("route_events", """
SELECT event_id, entity,
       CASE entity WHEN 'Employee' THEN 'users_Employee' WHEN 'users' THEN 'users_Employee'
            WHEN 'Task' THEN 'tasks_Task' WHEN 'tasks' THEN 'tasks_Task' END AS mapping,
       CASE WHEN entity = 'Invoice' THEN
         CASE WHEN source = 'a' THEN 'doctype_not_configured' ELSE 'table_not_configured' END END AS reason
FROM gate_events""")
def route_events(t: Tables):
    table = ev.routes(t.spark, presets.ALL)
    return ev.route(t("gate_events"), table).select("event_id", "entity", "mapping", "reason")


@query("direction_gate", """
SELECT event_id,
       CASE WHEN kind = 'other' THEN NULL
            WHEN original_source IN ('a', 'b') AND original_source <> source THEN NULL
            WHEN source = 'a' THEN 'a2b' ELSE 'b2a' END AS direction
FROM gate_events""")
def direction_gate(t: Tables):
    routed = ev.route(t("gate_events"), ev.routes(t.spark, presets.ALL))
    way = ev.direction(
        F.col("source"), F.col("a_type"), F.col("b_table"), F.col("original_source")
    )
    return routed.select("event_id", way.alias("direction"))


@query("mapping_gates", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'mapping_disabled'
            WHEN (p_size % 3 = 1 AND p_partkey % 2 = 0) THEN 'direction_not_allowed'
            WHEN p_type <> 'ECONOMY' THEN 'filtered_out' END AS reason
FROM part""")
def mapping_gates(t: Tables):
    rows = t("mapping_rows").join(
        t("part").withColumn("name", F.concat(F.lit("m"), F.col("p_partkey"))), "name"
    )
    way = F.when(F.col("p_partkey") % 2 == 0, "a2b").otherwise("b2a")
    reason = F.coalesce(
        ev.mapping_gate(way, F.col("enabled"), F.col("direction")),
        ev.filter_gate({"p_type": "ECONOMY"}),
    )
    return rows.select("p_partkey", reason.alias("reason"))
