"""Record identities, duplicate throttle and echo suppression."""

from pyspark.sql import functions as F

from tablesync.checks.registry import query
from tablesync.checks.views import Tables
from tablesync.functions import identity as ids
from tablesync.functions.text import snippet
from tablesync.operators import dedup
from tablesync.operators.match import identity_collisions as collisions

SIX_HOURS_MS = 6 * 3600 * 1000
SIX_HOURS_US = SIX_HOURS_MS * 1000


def micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("normalize_phone", r"""
SELECT name, CASE WHEN length(d) >= 10 THEN right(d, 10) END AS phone
FROM (SELECT name, regexp_replace(cell_number, '[^\p{Nd}]', '', 'g') AS d FROM a_person) p""")
def normalize_phone(t: Tables):
    return t("a_person").select("name", ids.normalize_phone(F.col("cell_number")).alias("phone"))


_PHONE_SQL = r"CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace({0}, '[^0-9]', '', 'g'), 10) END"


@query("identity_person", f"""
SELECT name, coalesce({_PHONE_SQL.format('cell_number')}, nullif(personal_email, '')) AS identity FROM a_person
UNION ALL
SELECT id AS name, coalesce({_PHONE_SQL.format('phone_number')}, nullif(email, '')) AS identity FROM b_person""")
def identity_person(t: Tables):
    a, b = t("a_person"), t("b_person")
    return a.select("name", ids.person_key(a.columns, "a2b").alias("identity")).unionByName(
        b.select(F.col("id").alias("name"), ids.person_key(b.columns, "b2a").alias("identity"))
    )


_SNIP = r"regexp_replace(replace(substring({0}, 1, 50), chr(10), ' '), '^\s+|\s+$', '', 'g')"


@query("dedup_identity", f"""
SELECT name AS rid, CASE WHEN {_PHONE_SQL.format('cell_number')} IS NOT NULL
         THEN concat('phone:', {_PHONE_SQL.format('cell_number')})
         WHEN personal_email <> '' THEN concat('email:', personal_email) END AS identity FROM a_person
UNION ALL
SELECT name AS rid, concat('subject:', subject,
         CASE WHEN description IS NULL THEN '' ELSE concat('_desc:', {_SNIP.format('description')}) END) AS identity
FROM a_task
UNION ALL
SELECT name AS rid, concat('name:', name) AS identity FROM a_project""")
def dedup_identity(t: Tables):
    parts = []
    for view, entity in (("a_person", "Employee"), ("a_task", "Task"), ("a_project", "Project")):
        df = t(view)
        key = ids.dedup_identity(F.lit(entity), df.columns)
        parts.append(df.select(F.col("name").alias("rid"), key.alias("identity")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("match_identity", f"""
SELECT name AS rid, 'task_subject' AS kind, concat(subject,
         CASE WHEN description IS NULL THEN '' ELSE concat('|', {_SNIP.format('description')}) END) AS value FROM a_task
UNION ALL
SELECT name AS rid, CASE WHEN {_PHONE_SQL.format('cell_number')} IS NOT NULL THEN 'phone'
                         WHEN personal_email <> '' THEN 'email' END AS kind,
       coalesce({_PHONE_SQL.format('cell_number')}, nullif(personal_email, '')) AS value FROM a_person
UNION ALL
SELECT name AS rid, CASE WHEN percent_complete IS NOT NULL THEN 'task_subject' END AS kind, name AS value
FROM a_project""")
def match_identity(t: Tables):
    parts = []
    for view, renames in (
        ("a_task", {}), ("a_person", {}), ("a_project", {"percent_complete": "progress"})
    ):
        df = t(view).withColumnsRenamed(renames)
        kind, value = ids.match_identity(df.columns, "a2b")
        parts.append(df.select(F.col("name").alias("rid"), kind.alias("kind"), value.alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("desc_snippet", f"""
SELECT doc_id, {_SNIP.format('text')} AS snippet FROM documents""")
def desc_snippet(t: Tables):
    return t("documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@query("identity_collisions", """
SELECT concat('subject:', o_orderstatus, ' ', o_orderpriority) AS identity, count(*) AS n_records,
       min(o_orderkey) AS first_id, max(o_orderkey) AS last_id
FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 1""")
def identity_collisions(t: Tables):
    orders = t("orders").withColumn("subject", F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    return collisions(orders, ids.task_identity(["subject"]), "o_orderkey")


@query("dedup_throttle", f"""
WITH RECURSIVE e AS (
  SELECT event_id, event_id % 2 AS src, user_id, epoch_us(ts) AS us FROM events),
acc AS (
  SELECT src, user_id, min(us) AS us FROM e GROUP BY src, user_id
  UNION ALL
  SELECT e.src, e.user_id, min(e.us) AS us FROM acc a
  JOIN e ON e.src = a.src AND e.user_id = a.user_id AND e.us >= a.us + {SIX_HOURS_US}
  GROUP BY e.src, e.user_id),
kept AS (
  SELECT min(e.event_id) AS event_id FROM acc JOIN e USING (src, user_id, us) GROUP BY src, user_id, us)
SELECT e.event_id, e.user_id, k.event_id IS NOT NULL AS accepted
FROM e LEFT JOIN kept k ON k.event_id = e.event_id""")
def dedup_throttle(t: Tables):
    events = t("events").select(
        "event_id", "user_id", micros().alias("us"),
        F.concat_ws(":", F.col("event_id") % 2, F.col("user_id")).alias("key"),
    )
    out = dedup.throttle(events, F.col("key"), F.col("us"), SIX_HOURS_MS)
    return out.select("event_id", "user_id", "accepted")


# Sequential reading of the gates: `base` gives (event_id, us, source, who, may).
GATE_CTES = f"""
acc AS (
  SELECT source, who, min(us) AS us FROM base WHERE who IS NOT NULL GROUP BY source, who
  UNION ALL
  SELECT e.source, e.who, min(e.us) AS us FROM acc a
  JOIN base e ON e.source = a.source AND e.who = a.who AND e.us >= a.us + {SIX_HOURS_US}
  GROUP BY e.source, e.who),
kept AS (
  SELECT who, source, us, min(event_id) AS event_id FROM acc JOIN base USING (source, who, us)
  GROUP BY who, source, us),
numbered AS (
  SELECT k.*, b.may, row_number() OVER (PARTITION BY k.who ORDER BY k.us, k.event_id) AS rn
  FROM kept k JOIN base b ON b.event_id = k.event_id),
played AS (
  SELECT who, rn, event_id, false AS echo, CASE WHEN source = 'a' AND may THEN us END AS ok_a,
         CASE WHEN source = 'b' AND may THEN us END AS ok_b
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.who, n.rn, n.event_id,
         coalesce(n.us - CASE WHEN n.source = 'a' THEN p.ok_b ELSE p.ok_a END < {SIX_HOURS_US}, false) AS echo,
         CASE WHEN n.source = 'a' AND n.may AND NOT coalesce(n.us - p.ok_b < {SIX_HOURS_US}, false)
              THEN n.us ELSE p.ok_a END AS ok_a,
         CASE WHEN n.source = 'b' AND n.may AND NOT coalesce(n.us - p.ok_a < {SIX_HOURS_US}, false)
              THEN n.us ELSE p.ok_b END AS ok_b
  FROM played p JOIN numbered n ON n.who = p.who AND n.rn = p.rn + 1),
gates AS (
  SELECT b.event_id, CASE WHEN b.who IS NULL THEN NULL WHEN p.event_id IS NULL THEN 'duplicate'
                          WHEN p.echo THEN 'echo' END AS gate
  FROM base b LEFT JOIN played p ON p.event_id = b.event_id)"""

_MAY = """(kind <> 'other' AND NOT coalesce(original_source IN ('a', 'b') AND original_source <> source, false))"""


def _gated(t: Tables):
    events = t("gate_events").select(
        "event_id", "source", "original_source", F.col("kind").alias("entity"), micros().alias("us"),
        F.col("user_id").cast("string").alias("identity"),
    )
    may = F.expr(_MAY.replace("kind", "entity"))
    return dedup.gate_outcome(events, may_succeed=may, window_ms=SIX_HOURS_MS)


_GATE_BASE = f"""base AS (
  SELECT event_id, epoch_us(ts) AS us, source, concat(kind, ':', cast(user_id AS string)) AS who,
         {_MAY} AS may FROM gate_events)"""


@query("echo_suppress", f"""
WITH RECURSIVE {_GATE_BASE},
{GATE_CTES}
SELECT event_id, gate FROM gates""")
def echo_suppress(t: Tables):
    return _gated(t).select("event_id", "gate")


@query("dedup_stats", f"""
WITH RECURSIVE {_GATE_BASE},
{GATE_CTES},
newest AS (SELECT max(us) AS now FROM base),
j AS (SELECT b.source, b.who, b.us, g.gate, n.now - b.us AS age FROM base b JOIN gates g USING (event_id), newest n)
SELECT source, count(*) FILTER (WHERE gate IS NULL OR gate <> 'duplicate') AS accepted_events,
       count(*) FILTER (WHERE gate = 'duplicate') AS duplicates,
       count(*) FILTER (WHERE gate = 'echo') AS echoes,
       count(DISTINCT CASE WHEN (gate IS NULL OR gate <> 'duplicate') AND age <= {2 * SIX_HOURS_US} THEN who END) AS active_keys,
       count(DISTINCT CASE WHEN gate IS NULL AND age < {SIX_HOURS_US} THEN who END) AS synced_keys
FROM j GROUP BY source""")
def dedup_stats(t: Tables):
    newest = t("events").agg(F.max(micros()).alias("now"))
    return dedup.state_stats(_gated(t), newest.scalar(), SIX_HOURS_MS)
