"""Whole batches and streams on a small set of records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablesync import presets
from tablesync.plans.sync_batch import Side, sync_batch
from tablesync.profiles import A2B, default_match_keys
from tablesync.session import run_to_end
from tablesync.sources.landing import quarantine, read_events, stream_events, usable
from tablesync.streaming.gate import gate_stream
from tablesync.streaming.sync import SyncStream

from test_dedup import sequential

A_TASK = "name string, subject string, status string, description string, modified string"
B_TASK = "id string, task_name string, status string, page_content string, updated_at string"


def event(n, ts, source, record, operation="update", original=None):
    entity = "Task" if source == "a" else "tasks"
    return (n, ts, source, entity, f"r{n}", operation, original, json.dumps(record))


SCHEMA = (
    "event_id bigint, us bigint, source string, entity string, record_id string, operation string, "
    "original_source string, data string"
)


def task(subject, status, stamp="2025-03-01 10:00:00", **more):
    return {"name": subject, "subject": subject, "status": status, "modified": stamp, **more}


@pytest.fixture()
def tables(spark):
    a = spark.createDataFrame([("TASK-1", "one", "Open", None, "2025-01-01 00:00:00")], A_TASK)
    b = spark.createDataFrame(
        [
            ("b1", "one", "Open", "kept", "2025-01-01T00:00:00Z"),
            ("b2", "two", "Open", None, "2026-01-01T00:00:00Z"),
            ("b3", "three", "Open", None, "2025-01-01T00:00:00Z"),
        ],
        B_TASK,
    )
    return {"Task": Side(A_TASK, a)}, {"tasks": Side(B_TASK, b)}


def test_batch_outcomes_and_merge(spark, tables):
    s = 1_000_000
    events = [
        event(1, 0, "a", task("one", "Done")),  # newer than the target: written
        event(2, 1000, "a", task("one", "Again")),  # same identity within T: duplicate
        event(3, 10_000, "b", {"task_name": "one", "status": "Echo"}),  # other side: echo
        event(4, s, "a", task("two", "Done")),  # target is newer: target wins
        event(5, 2 * s, "a", task("new", "Open"), "create"),
        event(6, 3 * s, "a", task("new", "Closed")),  # created above: update
        event(7, 4 * s, "a", task("three", "x"), "delete"),
        event(8, 5 * s, "a", task("gone", "x"), "delete"),
        event(9, 6 * s, "b", {"task_name": "q", "status": "x"}, original="a"),
    ]
    df = spark.createDataFrame(events, SCHEMA)
    result = sync_batch(df, [presets.TASK], *tables, window_ms=500, merge=True)
    got = {r.event_id: (r.operation, r.status, r.reason) for r in result.ledger.collect()}
    assert got == {
        1: ("update", "success", None),
        2: ("update", "skipped", "duplicate_webhook"),
        3: ("update", "skipped", "opposite_service_webhook_after_sync"),
        4: ("update", "skipped", "target_wins"),
        5: ("create", "success", None),
        6: ("update", "success", None),
        7: ("delete", "success", None),
        8: ("delete", "success", "record_not_found"),
        9: ("update", "skipped", "direction_not_allowed"),
    }
    after = {r.task_name: r for r in result.tables["tasks_Task", A2B].collect()}
    assert set(after) == {"one", "two", "new"}
    assert (after["one"].id, after["one"].status, after["one"].page_content) == ("b1", "Done", "kept")
    assert after["two"].status == "Open" and after["new"].status == "Closed"


def ledger(result):
    rows = result.ledger.collect()
    return [(r.event_id or 0, r.operation, r.status, r.reason) for r in rows]


def test_deliveries_of_one_event_are_applied_once(spark, tables):
    events = [event(1, 0, "a", task("one", "Done"))] * 3 + [(None, *event(2, 5, "a", task("two", "x"))[1:])]
    result = sync_batch(spark.createDataFrame(events, SCHEMA), [presets.TASK], *tables, merge=True)
    again = (1, "update", "skipped", "duplicate_webhook")
    want = [(0, "update", "error", "no_event_id"), (1, "update", "success", None), again, again]
    assert sorted(ledger(result), key=str) == sorted(want, key=str)
    assert result.targets["b", "tasks"].count() == 3


def test_unreadable_records_are_errors_and_write_nothing(spark, tables):
    bad = (1, 0, "a", "Task", "r1", "update", None, '{"name": broken')
    typed = B_TASK.replace("status string", "status int")
    b = tables[1]["tasks"].table.withColumn("status", F.lit(None).cast("int"))
    events = [bad, event(2, 10**6, "a", task("one", "many")), event(3, 2 * 10**6, "a", task("two", "7"))]
    result = sync_batch(
        spark.createDataFrame(events, SCHEMA), [presets.TASK], tables[0], {"tasks": Side(typed, b)}, merge=True
    )
    got = {r.event_id: (r.status, r.reason) for r in result.ledger.collect()}
    assert got[1] == ("error", "malformed_record")
    assert got[2][0] == "error" and "status" in got[2][1]
    assert got[3][0] in ("success", "skipped")
    assert result.targets["b", "tasks"].where("task_name = 'one' and status is null").count() == 1


def test_filters_keep_records_back(spark, tables):
    events = [event(1, 0, "a", task("one", "Closed")), event(2, 10**6, "a", task("two", "Open", "2027-01-01 00:00:00"))]
    spec = presets.TASK.with_(filters={"status": "Open"})
    result = sync_batch(spark.createDataFrame(events, SCHEMA), [spec], *tables)
    got = {r.event_id: (r.status, r.reason) for r in result.ledger.collect()}
    assert got == {1: ("skipped", "filtered_out"), 2: ("success", None)}


def test_mappings_of_one_target_are_merged_once(spark, tables):
    issue = presets.TASK.with_(name="tasks_Issue", a_type="Issue")
    rows = [event(1, 0, "a", task("new task", "Open"), "create"), event(2, 10**6, "a", task("new issue", "Open"), "create")]
    rows[1] = (*rows[1][:3], "Issue", *rows[1][4:])
    a_sides = {**tables[0], "Issue": tables[0]["Task"]}
    result = sync_batch(spark.createDataFrame(rows, SCHEMA), [presets.TASK, issue], a_sides, tables[1], merge=True)
    names = {r.task_name for r in result.targets["b", "tasks"].collect()}
    assert names == {"one", "two", "three", "new task", "new issue"}


def test_default_match_keys():
    keys = default_match_keys({"subject": "task_name", "description": "page_content", "status": "status"})
    assert keys == presets.TASK.match_keys
    person = default_match_keys({"cell_number": "phone_number", "personal_email": "email", "status": "x"})
    assert [(k.kind, k.a_col, k.b_col) for k in person] == [
        ("email", "personal_email", "email"), ("phone", "cell_number", "phone_number"),
    ]
    assert default_match_keys({"x": "y"}) == ()


def test_mapping_without_any_key_creates(spark, tables):
    spec = presets.TASK.with_(match_keys=())
    row = sync_batch(spark.createDataFrame([event(1, 0, "a", task("one", "Done"))], SCHEMA), [spec], *tables).ledger.first()
    assert (row.operation, row.status) == ("create", "success")


def test_manual_conflicts_wait_for_a_person(spark, tables):
    df = spark.createDataFrame([event(1, 0, "a", task("one", "Done"))], SCHEMA)
    result = sync_batch(df, [presets.TASK.with_(strategy="manual")], *tables, merge=True)
    row = result.ledger.first()
    assert (row.status, row.reason) == ("conflict", "manual_resolution")
    assert "status" in row.conflict_fields
    assert result.tables["tasks_Task", A2B].where("status = 'Done'").count() == 0


def test_disabled_mapping_lets_nothing_through(spark, tables):
    df = spark.createDataFrame([event(1, 0, "a", task("one", "Done"))], SCHEMA)
    row = sync_batch(df, [presets.TASK.with_(enabled=False)], *tables).ledger.first()
    assert (row.status, row.reason) == ("skipped", "mapping_disabled")


def test_broken_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"event_id":1,"ts":"2025-01-01T00:00:00Z","source":"a","entity":"Task"}\n{oops\n{"event_id":2}\n')
    events = read_events(spark, str(tmp_path)).cache()
    assert usable(events).count() == 1 and quarantine(events).count() == 2
    events.unpersist()


def _gate_files(spark, folder, events, parts):
    """Writes the events as `parts` files in arrival order."""
    for p in range(parts):
        rows = [e for e in events if e[-1] == p]
        df = spark.createDataFrame(
            [(e, u, s, "person", w, m, str(e)) for e, u, s, w, m, _ in rows],
            "event_id long, us long, source string, entity string, identity string, may boolean, carry string",
        ).withColumn("ts", F.timestamp_micros("us")).drop("us")
        df.coalesce(1).write.parquet(f"{folder}/part{p}")


def test_gate_stream_equals_the_rules_out_of_order(spark, tmp_path):
    rng = random.Random(11)
    events = []
    for i in range(600):
        us = rng.randrange(0, 60_000_000)
        arrival = min(2, max(0, us // 20_000_000 + rng.choice([-1, 0, 0])))  # up to 20 s early
        events.append((i, us, rng.choice("ab"), rng.choice("xyz"), rng.random() < 0.9, arrival))
    # one far later event moves the watermark past all the others
    events.append((9999, 10**12, "a", "end", True, 2))
    _gate_files(spark, tmp_path / "in", events, 3)
    schema = spark.read.parquet(f"{tmp_path}/in/part0").schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    out = run_to_end(gate_stream(stream, 500, "70 seconds"), "gate-test")
    got = {r.event_id: r.gate for r in out.collect() if r.event_id != 9999}
    want = sequential([e[:5] for e in events if e[0] != 9999], 500_000)
    assert got == want


def test_stream_survives_a_restart_and_replays_nothing(spark, tmp_path, tables):
    root = str(tmp_path / "run")
    (tmp_path / "in").mkdir()

    def land(name, rows):
        lines = [
            json.dumps({"event_id": n, "ts": ts, "source": s, "entity": e, "record_id": r, "operation": o,
                        "original_source": None, "data": d})
            for n, ts, s, e, r, o, _, d in rows
        ]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        stream = SyncStream(
            spark, root, [presets.TASK], {"Task": A_TASK}, {"tasks": B_TASK}, window_ms=500, delay="0 seconds"
        )
        stream.load("a", "Task", tables[0]["Task"].table)
        stream.load("b", "tasks", tables[1]["tasks"].table)
        for query in stream.start(str(tmp_path / "in")):
            query.awaitTermination()
        return stream

    land("1.json", [event(1, "2025-03-01T10:00:00Z", "a", task("one", "Done")),
                    event(2, "2025-03-01T10:00:00.100Z", "a", task("one", "Twice"))])
    first = run()
    assert {r.event_id: r.reason for r in first.ledger.read().collect()} == {1: None, 2: "duplicate_webhook"}
    batches = first.ledger.batches()
    land("2.json", [event(3, "2025-03-01T11:00:00Z", "a", task("one", "Later", "2025-03-02 10:00:00"))])
    again = run()
    assert again.ledger.batches()[: len(batches)] == batches
    assert {r.event_id for r in again.ledger.read().collect()} == {1, 2, 3}
    table = again.table("b", "tasks").read()
    assert table.where("task_name = 'one'").first().status == "Later" and table.count() == 3


def test_late_and_waiting_events_are_never_lost(spark, tmp_path, tables):
    (tmp_path / "in").mkdir()

    def land(name, *events, broken=0):
        lines = [json.dumps({"event_id": n, "ts": ts, "source": "a", "entity": "Task", "record_id": "r",
                             "operation": "update", "original_source": None, "data": d}) for n, ts, d in events]
        (tmp_path / "in" / name).write_text("\n".join(lines + ["{broken"] * broken) + "\n")

    stream = SyncStream(
        spark, str(tmp_path / "run"), [presets.TASK], {"Task": A_TASK}, {"tasks": B_TASK}, window_ms=500, delay="1 hour"
    )
    stream.load("a", "Task", tables[0]["Task"].table)
    stream.load("b", "tasks", tables[1]["tasks"].table)

    def outcome(drain=False):
        for query in stream.start(str(tmp_path / "in")):
            query.awaitTermination()
        if drain:
            stream.drain()
        return {(r.event_id, r.status, r.reason) for r in stream.ledger.read().collect()}

    late_task, nameless = task("late", "X"), json.dumps({"status": "Z"})
    land("1.json", (1, "2025-03-01T10:00:00Z", task("one", "A")), (2, "2025-03-01T12:00:00Z", task("two", "B")), broken=1)
    assert outcome() == {(1, "success", None)}
    assert [r.event_id for r in stream.waiting.collect()] == [2]
    # behind the watermark (11:00): late, with or without an identity; within the delay: in order
    land("2.json", (3, "2025-03-01T10:59:59.999Z", late_task), (4, "2025-03-01T11:59:59.800Z", task("two", "C")),
         (5, "2025-03-01T10:30:00Z", nameless), (6, "2025-03-01T12:30:00Z", nameless), (6, "2025-03-01T12:30:00Z", nameless))
    assert outcome() >= {(3, "skipped", "late"), (5, "skipped", "late")}
    done = outcome(drain=True)
    # the second of the two in time came first
    assert {n for n, _, r in done if r == "duplicate_webhook"} >= {2} and (4, "skipped", "duplicate_webhook") not in done
    ledger, bad = stream.ledger.read().count(), spark.read.text(stream.rejected).count()
    assert (ledger, bad, stream.waiting.count()) == (7, 1, 0)
    stream.drain()  # nothing waits: nothing happens
    assert stream.ledger.read().count() == 7
    # marks leave with the watermark: those of hours before are gone
    assert {r.identity for r in stream.marks.collect()} <= {"Task:subject:two"}
    land("3.json", (7, "2025-03-02T12:00:00Z", task("one", "D")), (8, "2025-03-02T14:00:00Z", task("one", "E")))
    outcome()
    assert [r.eid for r in stream.marks.collect()] == []


def test_landing_stream_has_the_corrupt_column(spark, tmp_path):
    assert stream_events(spark, str(tmp_path)).isStreaming
