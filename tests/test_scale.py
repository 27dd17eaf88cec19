"""Steps whose cost has to grow with the input only: how often rows are read and where they meet."""

import datetime as dt


from tablesync import presets
from tablesync.checks import operations, streams, sync, views
from tablesync.operators import lookups as lk
from tablesync.operators.events import route, routes
from tablesync.plans import sync_batch as sb
from tablesync.profiles import A2B, MappingSpec
from tablesync.session import stage


def test_routes_go_to_the_events(spark):
    """No shuffle by source and entity: there are only a few of those, so all events would meet in a few tasks."""
    rows = [(1, "a", "Employee"), (2, "b", "tasks"), (3, "a", "Invoice"), (4, None, "Task"), (5, "b", None)]
    events = stage(spark.createDataFrame(rows, "event_id long, source string, entity string"), "routed")
    out = route(events, routes(spark, presets.ALL))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    found = {r.event_id: r.mapping for r in out.collect()}
    assert found[1] and found[2] and found[3] is None and found[4] is None and found[5] is None and len(found) == 5


def _tables(spark, folder):
    """Events of users with, without and with several records; keys that are null or repeated."""
    at = dt.datetime(2025, 1, 1)
    events = [(n, at + dt.timedelta(minutes=n), user, kind, float(n), "{}")
              for n, (user, kind) in enumerate([(1, "signup"), (1, "error"), (2, "view"), (None, "view"), (77, "view"), (3, "click")])]
    events.append(events[0])
    customers = [(k, f"Customer#{k:09d}", 1, 0.0, "BUILDING") for k in (1, 1, 2, 1000003, 3)] + [(None, None, 1, 0.0, None)]
    orders = [(k, 1, "O", 0.0, at, "1-URGENT") for k in (1, 2, 2, 5)] + [(None, None, "F", 0.0, None, None)]
    schemas = {
        "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
        "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    }
    for name, rows in (("events", events), ("customer", customers), ("orders", orders)):
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{folder}/{name}.parquet")
    return views.Tables(spark, str(folder))


def test_records_are_looked_up_once_per_user(spark, tmp_path):
    """The event records as Spark derives them have the rows of the SQL that both engines share."""
    t = _tables(spark, tmp_path)
    for name in ("event_records", "landed_events"):
        ours, shared = t(name), spark.sql(views.standalone(views.VIEWS[name]))
        assert ours.schema.simpleString() == shared.schema.simpleString()
        assert sorted(map(repr, ours.collect())) == sorted(map(repr, shared.collect()))
    assert "asked" not in views.standalone(views.VIEWS["landed_events"])
    plan = t("event_records")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # the tables are cut to the users that the events name


def test_records_are_read_once_per_route(spark, tmp_path, monkeypatch):
    """Matching starts from staged rows: no plan behind it reads JSON again."""
    plans = {}
    real = sb.stage_all

    def seen(frames):
        plans.update({n: f._jdf.queryExecution().optimizedPlan().toString() for n, f in frames.items()})
        return real(frames)

    monkeypatch.setattr(sb, "stage_all", seen)
    schema = "id string, email string, phone_number string"
    a = {"Employee": sb.Side("name string, personal_email string", spark.createDataFrame([("E1", "x@y.z")], "name string, personal_email string"))}
    b = {"users": sb.Side(schema, spark.createDataFrame([("u1", "x@y.z", "1")], schema))}
    rows = [(1, 10, "a", "Employee", "E1", "update", None, '{"name":"E1","personal_email":"x@y.z"}')]
    events = spark.createDataFrame(
        rows, "event_id long, us long, source string, entity string, record_id string, operation string, original_source string, data string"
    )
    ledger = sb.sync_batch(events, [presets.PERSON], a, b).ledger.collect()
    assert [(r.operation, r.target_id) for r in ledger] == [("update", "u1")]
    matched = {n: p for n, p in plans.items() if n.startswith("matched")}
    assert matched and not any("from_json" in p or "json_object_keys" in p for p in matched.values())


def test_short_arrays_are_looked_up_in_their_row(spark):
    """Arrays up to `INLINE` elements and longer ones, empty and null ones, with null, unknown and known elements;
    the arrays of rows that share an id are put together. Rows of short arrays are not moved."""
    spec = MappingSpec(
        "lines", "Line", "sessions", {"name": "code", "items": "items"}, {},
        derive_a2b={"items": {"type": "array_to_uuid_array", "b_table": "suppliers", "a_field": "key", "b_field": "label"}},
    )
    label = {f"k{n}": f"L{n}" for n in range(9)}
    dim = spark.createDataFrame([*label.items(), ("k1", "Z"), (None, "N"), ("k2", None)], "key string, label string")
    lists = [None, [], ["k1"], ["x", None, "k2"], ["k3", "k3", "x", "k4"], [f"k{n}" for n in range(9)], ["x"] * 4 + [None, "k5"]]
    rows = [(f"r{n}", items) for n, items in enumerate(lists)]
    again = [("twice", ["k1", "x"]), ("twice", ["k1", "x"]), ("twice", None), (None, ["k1"])]
    df = spark.createDataFrame(rows + again, "name string, items array<string>")
    rules = lk.lookups(spec, A2B)
    got = sorted((r.name or "", r["_hit_items"]) for r in lk.with_hits(df, rules, {"suppliers": dim}, "name").collect())
    want = sorted((n, [label.get(i, i) for i in items] if items else None) for n, items in rows)
    want = [("", None), *want, *[("twice", ["L1", "L1", "x", "x"])] * 3]
    assert got == want
    plan = lk.with_hits(stage(df, "rows"), rules, {"suppliers": dim}, "name")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_events_that_arrive_in_parts_are_made_once(spark, tmp_path, monkeypatch):
    """Every part is read from the staged events: none joins the records again."""
    monkeypatch.setattr(streams, "_stream", lambda t, delay: (None, f"{tmp_path}/landing"))
    monkeypatch.setattr(streams, "_run", lambda stream, landing: None)
    t = _tables(spark, tmp_path)
    _, rows = streams._arriving(t, "0 seconds")
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    landed = spark.read.json(f"{tmp_path}/landing")
    assert sorted(r.event_id for r in landed.collect()) == sorted(r.event_id for r in t("landed_events").collect())


def test_broken_events_are_staged_once(spark, tmp_path, monkeypatch):
    """The engine's ledger reads the landed events and does not write them a second time."""
    names = []
    for module in (operations, sync):
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df, name, real=real: names.append(name) or real(df, name))
    ops = operations.engine_ledger(_tables(spark, tmp_path))
    assert [n for n in names if n in ("landed", "broken")] == ["landed"]
    assert {r.event_id for r in ops.select("event_id").collect()} == set(range(6))
