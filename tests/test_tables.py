"""Scans, matching, conflicts, merges, ledger, catalogs on small tables."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tablesync import presets
from tablesync.operators import apply as ap
from tablesync.operators import catalog as ct
from tablesync.operators import conflict as cf
from tablesync.operators import events as ev
from tablesync.operators import mapping as m
from tablesync.operators import mapping_table as mtab
from tablesync.operators import match, scan
from tablesync.operators import schema_match as sm
from tablesync.plans import ledger as lg
from tablesync.plans import metrics as mt
from tablesync.profiles import A2B, B2A
from tablesync.sources.buckets import BucketTable
from tablesync.sources.snapshots import BatchLog, SnapshotTable


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def test_scan_limit_needs_an_order_and_filters_are_strict(spark):
    df = spark.range(10)
    assert rows(scan.scan(df, [["id", ">", 3]], ["id"], limit=2, order_by=["id"])) == [(4,), (5,)]
    with pytest.raises(ValueError):
        scan.predicate([["id", "~", 3]])
    with pytest.raises(ValueError):
        scan.predicate([["id", "="]])


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("100% wool",), ("100 wool",), ("a_b",), ("axb",)], "name string")
    assert rows(scan.search(df, "name", "0% W")) == [("100% wool",)]
    assert rows(scan.search(df, "name", "A_B")) == [("a_b",)]


def test_upsert_respects_the_mask(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame(
        [(1, None, None, ["k", "p"]), (3, "n", "m", ["k", "p", "q"])],
        "k int, p string, q string, _present array<string>",
    )
    assert rows(scan.upsert(table, new, "k")) == [(1, None, "x"), (2, "b", "y"), (3, "n", "m")]


def test_snapshot_diff_and_its_events(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (3, "c"), (4, None)], "k int, v string")
    diff = ev.snapshot_diff(old, new, "k")
    assert rows(diff, "k", "operation") == [(2, "delete"), (3, "update"), (4, "create")]
    events = ev.event_rows(diff, "a", "Task", "k")
    data = {r.record_id: r.data for r in events.collect()}
    assert data == {"2": '{"k":2}', "3": '{"k":3,"v":"c"}', "4": '{"k":4,"v":null}'}


def test_match_by_subject_verifies_the_snippet(spark):
    target = spark.createDataFrame(
        [("1", "S", "other text"), ("2", "S", "see: Fix it now"), ("3", "T", None)],
        "id string, task_name string, page_content string",
    )
    tasks = spark.createDataFrame(
        [("a", "S", "Fix it"), ("b", "S", None), ("c", "T", "x"), ("d", None, None)],
        "name string, subject string, description string",
    )
    mapped = m.map_records(tasks, presets.TASK, A2B, keep=("name",))
    found = match.find_targets(mapped, target, presets.TASK, A2B, "id", salt="_name")
    # all rows of a subject are tested, the smallest id of those that fit is taken
    assert rows(found, "_name", "target_id", "found_id") == [
        ("a", "2", "1"), ("b", "1", "1"), ("c", None, "3"), ("d", None, None),
    ]


def test_many_targets_and_texts_of_one_subject(spark):
    target = spark.createDataFrame(
        [(f"{i:04d}", "hot", f"page {i % 50} end") for i in range(2000)] + [(f"x{i}", f"s{i}", "y") for i in range(500)],
        "id string, task_name string, page_content string",
    )
    tasks = [(f"n{i}", "hot", f"page {i % 60} end") for i in range(300)] + [("o", "s7", "y"), ("p", "s7", "z")]
    mapped = m.map_records(spark.createDataFrame(tasks, "name string, subject string, description string"), presets.TASK, A2B, keep=("name",))
    found = match.find_targets(mapped, target, presets.TASK, A2B, "id", ("page_content",), salt="_name")
    got = {r._name: (r.target_id, r.t_page_content) for r in found.collect()}
    want = {f"n{i}": (f"{i % 60:04d}", f"page {i % 60} end") if i % 60 < 50 else (None, None) for i in range(300)}
    assert got == want | {"o": ("x7", "y"), "p": (None, None)}
    # the target is cut to the keys of the batch before anything is aggregated
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_operations_follow_the_batch(spark):
    hour = 3_600_000_000
    events = spark.createDataFrame(
        [
            (1, 0, "x", "update", None), (2, 5 * hour, "x", "create", None), (3, 6 * hour, "x", "delete", None),
            (4, 9 * hour, "x", "update", None), (5, 1, "y", "create", "t"), (6, 2, "y", "delete", "t"),
            (7, 3, "y", "create", "t"), (8, 1, None, "update", None), (9, 2, None, "update", None),
        ],
        "event_id long, us long, match_value string, operation string, target_id string",
    )
    got = rows(match.resolve_operation(events), "event_id", "resolved")
    assert [op for _, op in got] == [
        "create", "update", "delete", "create", "update", "delete", "create", "create", "create",
    ]


def net(spark, changes):
    schema = "k int, us long, event_id long, operation string, p string, q string, _present array<string>"
    return ap.net_changes(spark.createDataFrame(changes, schema), "k")


def test_net_changes_and_merge(spark):
    both = ["p", "q"]
    changes = net(spark, [
        (1, 1, 1, "update", "p1", "q1", both), (1, 2, 2, "update", None, None, ["p"]),
        (2, 1, 3, "delete", None, None, []), (2, 2, 4, "create", "p2", None, ["p"]),
        (3, 1, 5, "update", "p3", None, ["p"]), (3, 2, 6, "delete", None, None, []),
        (4, 1, 7, "create", "p4", "q4", both), (5, 1, 8, "delete", None, None, []),
    ])
    table = spark.createDataFrame(
        [(1, "a", "a", 1), (2, "b", "b", 2), (3, "c", "c", 3), (6, "d", "d", 4)], "k int, p string, q string, r int"
    )
    after = ap.apply_changes(table, changes, "k")
    assert rows(after) == [
        (1, None, "q1", 1), (2, "p2", None, None), (4, "p4", "q4", None), (6, "d", "d", 4),
    ]
    assert rows(ap.apply_changes(after, changes, "k")) == rows(after)


def test_hot_key_changes_collapse_before_the_merge(spark):
    changes = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).cast("int").alias("k"),
        F.col("id").alias("us"), F.col("id").alias("event_id"), F.lit("update").alias("operation"),
        F.col("id").cast("string").alias("p"),
    )
    out = ap.net_changes(changes, "k")
    hot = out.where("k = 0").first()
    assert (hot.n_changes, hot.p) == (20_001, "29999") and out.count() == 10_000


def test_resolution(spark):
    stamps = [
        ("2025-01-27 10:00:00", "2025-01-27T11:00:00Z", "b"), ("2025-01-27 12:00:00", "2025-01-27T11:00:00Z", "a"),
        ("2025-01-27 11:00:00", "2025-01-27T11:00:00Z", "b"), ("2025-01-27 11:00:00", None, "a"),
        (None, "2025-01-27T11:00:00Z", "b"), (None, None, "b"), ("2025-01-27 23:00:00", "2025-01-27T01:00:00Z", "a"),
    ]
    df = spark.createDataFrame([s[:2] for s in stamps], "a string, b string")
    got = df.select(cf.newer_side(F.col("a"), F.col("b")).alias("w"),
                    cf.newer_side(F.col("a"), F.col("b"), compat_lexicographic=True).alias("c")).collect()
    assert [r.w for r in got] == [s[2] for s in stamps]
    assert got[-1].c == "b"  # as text, a blank sorts before a T


def test_strategies(spark):
    df = spark.createDataFrame([("a_wins",), ("b_wins",), ("manual",), ("last_modified_wins",)], "s string")
    status, reason = cf.conflict_status(F.col("s"), F.lit("a"), F.lit("a"))
    assert [tuple(r) for r in df.select(status, reason).collect()] == [
        ("success", None), ("skipped", "target_wins"), ("conflict", "manual_resolution"), ("success", None),
    ]
    with pytest.raises(ValueError):
        cf.detect_conflicts(df, presets.TASK.with_(strategy="coin"), A2B)


def test_compared_fields_follow_the_mapping_unless_told_otherwise():
    assert ("subject", "task_name") in cf.compared_fields(presets.TASK, A2B)
    assert ("task_name", "subject") in cf.compared_fields(presets.TASK, B2A)
    assert ("subject", "subject") in cf.compared_fields(presets.TASK, A2B, compat_same_name=True)


LEDGER = "op_id string, status string, retry_count int, error string, duration double, created_at timestamp, event_id long"


def ledger(spark, entries):
    return spark.createDataFrame(
        [(i, s, r, None, d, None, n) for n, (i, s, r, d) in enumerate(entries)], LEDGER
    ).withColumn("created_at", F.timestamp_micros("event_id")).withColumn("completed_at", F.col("created_at"))


def test_retries_and_transitions(spark):
    df = ledger(spark, [("a", "failed", 0, 1.0), ("b", "failed", 3, 1.0), ("c", "processing", 0, 1.0), ("d", "processing", 1, 1.0)])
    assert rows(lg.plan_retries(df), "op_id", "status", "retry_count", "dead_letter") == [
        ("a", "pending", 1, False), ("b", "failed", 3, True), ("c", "processing", 0, False), ("d", "processing", 1, False),
    ]
    results = spark.createDataFrame([("c", True, None), ("d", False, "boom"), ("a", True, None)], "op_id string, ok boolean, error string")
    after = lg.transition(df, results.withColumn("at", F.current_timestamp()))
    assert rows(after, "op_id", "status", "error") == [("a", "failed", None), ("b", "failed", None), ("d", "failed", "boom")]


def test_metrics(spark):
    df = ledger(spark, [(str(i), s, 0, float(i)) for i, s in enumerate(["completed"] * 2 + ["failed"])])
    assert mt.rates(df).first().asDict() == {"success_rate": 66.67, "error_rate": 33.33}
    assert mt.summary(df).first().health == "degraded"
    stats = mt.duration_stats(df, samples=2).first()
    assert (stats.average, stats.samples, stats.recent) == (1.5, 2, [2.0, 1.0])
    assert mt.rates(df.limit(0)).first().asDict() == {"success_rate": 0.0, "error_rate": 0.0}


def test_field_matching_is_difflib(spark):
    def cat(table, fields):
        data = [(table, i, n, l, t) for i, (n, l, t) in enumerate(fields)]
        return spark.createDataFrame(data, "table string, ordinal int, fieldname string, label string, fieldtype string")

    a_fields = [("cell_number", "Cell Number", "Data"), ("status", None, "Select"), ("zzz", "Zzz", "Int")]
    b_fields = [("phone_number", "Phone Number", "varchar"), ("status", "Status", "text"), ("cell_no", "Cell No", "text")]
    a, b = cat("Person", a_fields), cat("persons", b_fields)
    got = {r.a_field: (r.b_field, r.score) for r in sm.match_fields(a, b, sm.match_tables(a, b)).collect()}

    def ratio(x, y):
        return SequenceMatcher(None, x.lower(), y.lower()).ratio()

    for name, label, kind in a_fields:
        scores = [
            0.4 * ratio(name, n) + 0.3 * (kind != "Int") + 0.3 * ratio(label or "", l) for n, l, _ in b_fields
        ]
        best = max(scores)
        want = (b_fields[scores.index(best)][0], round(best, 6)) if best > 0.7 else (None, None)
        assert got[name] == want
    assert sm.table_similarity("Sales_Order", "salesorder") == 1.0
    assert sm.table_similarity("Task", "project_tasks") == 0.8


def test_json_catalog_takes_the_widest_type(spark):
    lines = ['{"a":1,"b":null,"c":[1],"d":true,"e":"x"}', '{"a":1.5,"b":null,"d":null,"e":"%s"}' % ("y" * 300)]
    df = spark.createDataFrame([(l,) for l in lines], "data string")
    got = {r.fieldname: r.fieldtype for r in ct.catalog_from_json(df, "data", F.lit("t")).collect()}
    assert got == {"a": "numeric", "b": "text", "c": "jsonb", "d": "boolean", "e": "text"}


def test_mapping_validation_counts_null_keys_as_present(spark):
    df = spark.createDataFrame([('{"a_type":null,"b_table":"t","field_mappings":{}}',), ("{}",)], "conf string")
    got = [r.e for r in df.select(mtab.validation_errors(F.col("conf")).alias("e")).collect()]
    assert got[0] == [] and len(got[1]) == 3


def test_snapshots_commit_once_per_batch(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.latest() is None
    assert table.commit(spark.range(3), 0) and table.commit(spark.range(5), 2)
    assert not table.commit(spark.range(9), 2)
    assert table.read().count() == 5 and table.read(before=2).count() == 3
    log = BatchLog(spark, str(tmp_path / "l"))
    log.commit(spark.range(3), 1)
    log.commit(spark.range(4), 2)
    assert log.read().count() == 7


def test_buckets_without_changes_keep_their_files(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k", buckets=16, keep=2)
    first = spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("p"), F.lit("b").alias("q"), F.lit(1).alias("r"))
    assert table.commit(first, 0) and not table.commit(first, 0)
    before = table.files()
    assert len(before) == 16
    changes = net(spark, [(7, 1, 1, "update", "new", None, ["p"]), (500, 1, 2, "create", "x", "y", ["p", "q"]), (9, 1, 3, "delete", None, None, [])])
    assert table.merge(changes, 1) and not table.merge(changes, 1)
    after = table.files()
    touched = {r[0] for r in changes.select(table.bucket_of("k")).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched
    assert set(rows(table.read().where("k in (7, 9, 500)"))) == {(7, "new", "b", 1), (500, "x", "y", None)}
    assert table.read().count() == 200 and rows(table.read(before=1).where("k = 7")) == [(7, "a", "b", 1)]
    # nothing to write: no version, no file
    assert not table.merge(changes.limit(0), 2) and table.latest() == 1
    # old versions leave, with the files that only they have
    for n in (3, 4):
        table.merge(net(spark, [(7, n, n, "update", f"v{n}", None, ["p"])]), n)
    assert table.manifests.batches() == [3, 4]
    assert table.read().count() == 200 and rows(table.read().where("k = 7")) == [(7, "v4", "b", 1)]
    assert not (tmp_path / "t" / before[next(iter(touched))]).exists()
    everything = net(spark, [(i, 9, i, "delete", None, None, []) for i in [*range(200), 500]])
    assert table.merge(everything, 5) and table.read().count() == 0 and table.read().columns == first.columns


def test_mapping_validation_wants_containers_not_text(spark):
    rows = [
        ('{"a_type": "x", "b_table": "y", "field_mappings": "{x", "sync_fields": "[y"}',),
        ('{"a_type": "x", "b_table": "y", "field_mappings": {}, "sync_fields": []}',),
    ]
    df = spark.createDataFrame(rows, "conf string")
    got = [r.e for r in df.select(mtab.validation_errors(F.col("conf"), "api").alias("e")).collect()]
    assert [len(e) for e in got] == [2, 0]


def test_attempts_add_up_to_operations(spark):
    from tablesync.plans import operations as op

    names = "event_id long, source string, entity string, record_id string, direction string, operation string, target_id string, status string, reason string"
    events = spark.createDataFrame([(1, 10**6), (2, 2 * 10**6), (2, 5 * 10**6), (3, 10**6)], "event_id long, us long")

    def outcome(event_id, status, reason=None):
        return (event_id, "a", "Task", "r", "a2b", "update", "t", status, reason)

    def attempt(n, *rows_):
        return op.attempts(spark.createDataFrame(list(rows_), names), events, F.timestamp_seconds(F.lit(10 * n)), n)

    # a repeated delivery of a failed event is one operation with it
    log = attempt(1, outcome(1, "success"), outcome(2, "error", "bad"), outcome(2, "skipped", "duplicate"), outcome(3, "conflict", "manual"))
    ops = op.operations(log)
    assert rows(ops, "event_id", "status", "retry_count", "error", "duration") == [
        (1, "completed", 0, None, 9.0), (2, "failed", 0, "bad", 8.0), (3, "conflict", 0, None, 9.0),
    ]
    assert {r.event_id for r in op.reinjected(events, ops).collect()} == {2}
    for n in (2, 3, 4):
        log = log.unionByName(attempt(n, outcome(2, "error", f"bad {n}")))
    last = op.operations(log).where("event_id = 2").first()
    assert (last.status, last.retry_count, last.error) == ("failed", 3, "bad 4")
    assert op.reinjected(events, op.operations(log)).count() == 0  # a dead letter
    healed = op.operations(log.unionByName(attempt(5, outcome(2, "success")))).where("event_id = 2").first()
    assert (healed.status, healed.error) == ("completed", None) and healed.completed_at is not None


def test_decisions_settle_conflicts(spark):
    from tablesync.plans import conflicts as cr

    def clash(event_id, us, key, incoming, written):
        return (event_id, us, "m", "a2b", "b", "tasks", "r", key, "manual", "conflict", ["p"], incoming, "{}", written)

    found = spark.createDataFrame(
        [clash(1, 1, "k1", '{"p":"first","q":"x"}', ["p"]), clash(2, 2, "k1", '{"p":"second"}', ["p"]),
         clash(3, 3, "k2", '{"p":"third"}', ["p"]), clash(4, 4, "k3", '{"p":"fourth"}', ["p"])],
        cr.SCHEMA,
    )
    table = spark.createDataFrame([("k1", "a", "b"), ("k2", "c", "d"), ("k3", "e", "f")], "id string, p string, q string")
    said = spark.createDataFrame(
        [(1, "m", "incoming"), (2, "m", "incoming"), (3, "m", "target"), (4, "m", "perhaps"), (9, "m", "incoming")],
        "event_id long, mapping string, winner string",
    )
    after = cr.resolve_manual(found, said, {("b", "tasks"): table})["b", "tasks"]
    # played in the order of the events; what was not to be written stays
    assert rows(after) == [("k1", "second", "b"), ("k2", "c", "d"), ("k3", "e", "f")]
    assert rows(cr.settlements(found, said), "event_id", "status", "reason") == [
        (1, "success", "manual_incoming"), (2, "success", "manual_incoming"), (3, "skipped", "manual_target"),
    ]
