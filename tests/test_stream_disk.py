"""What a stream leaves on disk, and what it may remove while it runs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablesync import presets
from tablesync.checks import streams
from tablesync.operators.apply import apply_changes, net_changes
from tablesync.session import checkpoint_root, scratch, shuffles_removed, stage, stage_all, staging_in
from tablesync.sources import buckets
from tablesync.sources.snapshots import BatchLog
from tablesync.streaming.sync import SyncStream

A_TASK = "name string, subject string, status string, description string, modified string"
B_TASK = "id string, task_name string, status string, page_content string, updated_at string"
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _land(folder, name, *events):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"event_id": n, "ts": ts, "source": "a", "entity": "Task", "record_id": "r", "operation": "update",
                         "original_source": None, "data": json.dumps({"subject": s, "status": v, "modified": ts})})
             for n, ts, s, v in events]
    (folder / name).write_text("\n".join(lines) + "\n")


def _stream(spark, tmp_path):
    stream = SyncStream(
        spark, str(tmp_path / "run"), [presets.TASK], {"Task": A_TASK}, {"tasks": B_TASK}, window_ms=500, delay="0 seconds"
    )
    b = [("t1", "one", "Open", None, "2025-01-01T00:00:00Z"), ("t2", "two", "Open", None, "2025-01-01T00:00:00Z")]
    stream.load("a", "Task", spark.createDataFrame([("TASK-1", "one", "Open", None, "2025-01-01 00:00:00")], A_TASK))
    stream.load("b", "tasks", spark.createDataFrame(b, B_TASK))
    return stream


def _run(stream, tmp_path):
    for query in stream.start(str(tmp_path / "in")):
        query.awaitTermination()


def _staged(spark):
    return {p.name for p in Path(checkpoint_root(spark).removeprefix("file:")).iterdir()}


def test_a_batch_leaves_its_results_and_nothing_else(spark, tmp_path):
    before = _staged(spark)
    for n, status in enumerate(("Working", "Done", "Closed"), 1):
        _land(tmp_path / "in", f"{n}.json", (n, f"2025-03-0{n}T10:00:00Z", "one", status))
        stream = _stream(spark, tmp_path)
        _run(stream, tmp_path)
    assert _staged(spark) == before
    assert {r.event_id for r in stream.ledger.read().collect()} == {1, 2, 3}
    table = stream.table("b", "tasks")
    assert {(r.task_name, r.status) for r in table.read().collect()} == {("one", "Closed"), ("two", "Open")}
    # one version of the tables and the state, with its files alone; the logs keep all batches
    assert len(stream.ledger.batches()) == 3
    assert table.manifests.batches() == stream.ledger.batches()[-1:]
    data = {p.parent.relative_to(tmp_path / "run/b/tasks") for p in (tmp_path / "run/b/tasks/data").rglob("*.parquet")}
    assert data == {Path(p) for p in table.files().values()}
    for name in ("waiting", "marks", "clock"):
        assert stream._state(name).batches() == stream.ledger.batches()[-1:]


def test_a_batch_that_broke_off_is_played_again(spark, tmp_path, monkeypatch):
    """The tables as of the batch before stay until the ledger has the batch."""
    _land(tmp_path / "in", "1.json", (1, "2025-03-01T10:00:00Z", "one", "Working"))
    _run(_stream(spark, tmp_path), tmp_path)
    _land(tmp_path / "in", "2.json", (2, "2025-03-02T10:00:00Z", "one", "Done"), (3, "2025-02-01T10:00:00Z", "two", "Late"))
    real, before = BatchLog.commit, _staged(spark)

    def breaks(log, table, batch_id):
        if log.root.endswith("/ledger"):
            raise OSError("no ledger today")
        return real(log, table, batch_id)

    with monkeypatch.context() as m:
        m.setattr(BatchLog, "commit", breaks)
        with pytest.raises(Exception, match="no ledger today"):
            _run(_stream(spark, tmp_path), tmp_path)
    for query in spark.streams.active:
        query.awaitTermination()
    assert _staged(spark) == before
    stream = _stream(spark, tmp_path)
    assert {r.event_id for r in stream.ledger.read().collect()} == {1} and len(stream.table("b", "tasks").manifests.batches()) == 2
    _run(stream, tmp_path)
    assert {(r.event_id, r.reason) for r in stream.ledger.read().collect()} == {(1, None), (2, None), (3, "late")}
    assert stream.table("b", "tasks").read().where("task_name = 'one'").first().status == "Done"
    assert stream.table("b", "tasks").manifests.batches() == stream.ledger.batches()[-1:]


def test_staged_tables_go_with_their_scratch_folder(spark):
    before = _staged(spark)
    with scratch(spark, "outer"):
        with scratch(spark, "inner") as outside:
            first = stage(spark.range(3), "first")
            with staging_in(outside):
                kept = stage_all({"second": first.withColumn("x", F.lit(1)), "third": first})
        assert kept["second"].count() == kept["third"].count() == 3
        with pytest.raises(Exception):
            first.count()
        with scratch(spark, "none", on=False):
            same = stage(spark.range(2), "same")
        assert same.count() == 2
        assert len(_staged(spark) - before) == 1
    assert _staged(spark) == before


def test_shuffle_files_leave_with_their_query(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}
    was, before = spark.conf.get(_SHUFFLES, "false"), files()
    frame = spark.range(2000).withColumn("k", F.col("id") % 100).groupBy("k").count()
    with shuffles_removed(spark):
        frame.write.parquet(str(tmp_path / "one"))
        assert files() <= before
        frame.write.parquet(str(tmp_path / "two"))  # once more: it shuffles again
    assert spark.read.parquet(str(tmp_path / "two")).count() == 100
    assert spark.conf.get(_SHUFFLES) == was


def test_a_large_table_is_merged_in_rounds(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "k", buckets=16)
    first = spark.range(300).select(F.when(F.col("id") < 299, F.col("id")).cast("int").alias("k"), F.lit("a").alias("p"))
    first = first.unionByName(first.where("k = 7"))  # keys may repeat
    table.commit(first, 0)
    changes = [(k, 1, k, "delete" if k % 3 == 0 else "update", f"v{k}", ["p"]) for k in range(0, 400, 7)]
    net = net_changes(
        spark.createDataFrame(changes, "k int, us long, event_id long, operation string, p string, _present array<string>"), "k"
    )
    monkeypatch.setattr(buckets, "_ROUND_BYTES", 1)
    rounds, real = [], buckets.apply_changes
    monkeypatch.setattr(buckets, "apply_changes", lambda old, net, key: rounds.append(1) or real(old, net, key))
    # what an attempt that broke off has left is not read
    table._write(first, 1, "overwrite")
    assert table.merge(net, 1) and len(rounds) == 4
    whole = apply_changes(first, net, "k")
    assert sorted(map(str, table.read().collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, table.read(before=1).collect())) == sorted(map(str, first.collect()))


def test_events_land_in_small_compressed_files(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("x").alias("data")).coalesce(1)
    streams._land(rows, str(tmp_path / "in"))
    streams._land(rows.limit(5), str(tmp_path / "in"))
    files = [*(tmp_path / "in").glob("part-*")]
    assert len(files) == 4 and all(f.name.endswith(".json.gz") for f in files)
    assert spark.read.json(str(tmp_path / "in")).count() == 60_005
