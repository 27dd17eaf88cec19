"""The throttle and echo jobs against a plain sequential reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tablesync.operators.dedup import MARKS, accepted_events, gate_outcome, gate_step, throttle


def sequential(events, window_us):
    """event = (id, us, source, who, may) -> id -> None | 'duplicate' | 'echo'."""
    seen, synced, out = {}, {}, {}
    for eid, us, source, who, may in sorted(events, key=lambda e: (e[1], e[0])):
        if who is None:
            out[eid] = None
            continue
        last = seen.get((source, who))
        if last is not None and us - last < window_us:
            out[eid] = "duplicate"
            continue
        seen[source, who] = us
        other = synced.get(("b" if source == "a" else "a", who))
        if other is not None and us - other < window_us:
            out[eid] = "echo"
            continue
        out[eid] = None
        if may:
            synced[source, who] = us
    return out


def frame(spark, events):
    return spark.createDataFrame(
        [(e, u, s, "person", w, m) for e, u, s, w, m in events],
        "event_id long, us long, source string, entity string, identity string, may boolean",
    )


def run(spark, events, window_ms, leaf_bits, slice_windows, fan_bits=2):
    out = gate_outcome(
        frame(spark, events),
        may_succeed=F.col("may"),
        window_ms=window_ms,
        leaf_bits=leaf_bits,
        fan_bits=fan_bits,
        slice_windows=slice_windows,
    )
    return {r.event_id: r.gate for r in out.select("event_id", "gate").collect()}


def test_golden_throttle(spark):
    times = [0, 100, 499, 500, 600, 1000, 1001]
    df = spark.createDataFrame([(i, t * 1000, "k") for i, t in enumerate(times)], "event_id long, us long, k string")
    rows = throttle(df, F.col("k"), F.col("us"), 500).where("accepted").select("us").collect()
    assert sorted(r.us // 1000 for r in rows) == [0, 500, 1000]


def test_golden_echo(spark):
    events = [(1, 0, "a", "x", True), (2, 100_000, "b", "x", True), (3, 700_000, "b", "x", True)]
    assert run(spark, events, 500, 64, 64) == {1: None, 2: "echo", 3: None}


@pytest.mark.parametrize("seed,leaf_bits,slice_windows", [(1, 2, 1), (2, 5, 2), (3, 15, 4096)])
def test_random_events_match_the_sequential_rules(spark, seed, leaf_bits, slice_windows):
    rng = random.Random(seed)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(20)] + [None]
    events = [
        (i, rng.randrange(-3_000_000, 9_000_000), rng.choice("ab"), rng.choice(keys), rng.random() < 0.8)
        for i in range(3000)
    ]
    got = run(spark, events, 50, leaf_bits, slice_windows)
    assert got == sequential(events, 50_000)


def test_periodic_events_never_merge_their_chains(spark):
    # every start leads to a different chain: the case where chunk functions stay large
    events = [(i, i * 1000, "a", "hot", True) for i in range(4000)]
    events += [(10_000 + i, i * 1000 + 7, "b", "hot", i % 3 > 0) for i in range(4000)]
    for leaf_bits in (3, 6, 15):
        got = run(spark, events, 37, leaf_bits, 2)
        assert got == sequential(events, 37_000)


def test_long_alternating_runs_cross_slice_borders(spark):
    events = [(i, i * 30_000, "ab"[i % 2], "x", True) for i in range(400)]
    events += [(1000 + i, i * 30_000, "ab"[i % 2], "y", i % 7 != 0) for i in range(400)]
    for slice_windows in (1, 2, 3, 100):
        assert run(spark, events, 50, 4, slice_windows) == sequential(events, 50_000)


@pytest.mark.parametrize("seed,window_ms", [(1, 1000), (2, 1000), (3, 9000), (4, 400 * 86_400_000)])
def test_dense_keys_keep_their_chain(spark, seed, window_ms):
    """Windows that hold many leaves of one key, up to all of them."""
    rng = random.Random(seed)
    events = [
        (i, rng.randrange(0, 40_000_000), rng.choice("ab"), "hot" if i % 3 else f"k{i % 50}", rng.random() < 0.9)
        for i in range(6000)
    ]
    got = run(spark, events, window_ms, 4, 4)
    assert got == sequential(events, window_ms * 1000)


def test_a_hot_key_over_two_thousand_windows(spark):
    rng = random.Random(6)
    events = [(i, rng.randrange(0, 2_000_000_000), "a", "hot", True) for i in range(8000)]
    events += [(10_000 + i, rng.randrange(0, 2_000_000_000), rng.choice("ab"), f"k{i % 4000}", True) for i in range(16_000)]
    assert run(spark, events, 1000, 5, 64) == sequential(events, 1_000_000)


def test_leaves_that_no_chain_reaches_are_out():
    import numpy as np

    from tablesync.operators.dedup import _reachable

    us = np.arange(0, 50_000_000, 500)
    lo, hi = us[::64], np.append(us[63::64], us[-1])[: len(us[::64])]
    assert _reachable(lo, hi, 1_000_000).sum() < 1300 < len(lo)
    assert _reachable(lo, hi, 10**12).tolist() == [True] + [False] * (len(lo) - 1)


def test_composed_functions_equal_the_chain():
    import numpy as np
    import pyarrow as pa

    from tablesync.operators.dedup import _functions, _leaf_functions, compose

    rng = np.random.default_rng(3)
    for window in (3, 40, 2000):
        us = np.unique(rng.integers(0, 3000, 700)) + 5000
        table = pa.table({"k": ["x"] * len(us), "leaf": np.arange(len(us)) // 16, "us": us})
        table = table.append_column("rank", table.column("leaf"))
        made = pa.Table.from_batches(list(_leaf_functions(("k",), window)(iter(table.to_batches()))))
        upto, exits = compose(_functions(made), int(us[0]), window)
        for anchor in range(5000 - window, 5000):
            last = anchor
            for u in us.tolist():
                last = u if u - last >= window else last
            at = int(np.searchsorted(upto, anchor + window))
            assert (int(exits[at]) if at < len(upto) else anchor) == last


def test_steps_of_a_gate_equal_one(spark):
    rng = random.Random(9)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)] + [None]
    events = [
        (i, rng.randrange(0, 3_000_000), rng.choice("ab"), rng.choice(keys), rng.random() < 0.8) for i in range(1200)
    ]
    marks = spark.createDataFrame([], MARKS)
    got = {}
    for start in range(0, 3_000_000, 750_000):
        part = frame(spark, [e for e in events if start <= e[1] < start + 750_000])
        gated, marks = gate_step(part, marks, may_succeed=F.col("may"), window_ms=50)
        got |= {r.event_id: r.gate for r in gated.collect()}
    assert got == sequential(events, 50_000)


def test_same_instant_copies_keep_the_first_id(spark):
    events = [(i, 5_000, "a", "x", True) for i in range(50)]
    got = run(spark, events, 50, 4, 4)
    assert [i for i, gate in got.items() if gate is None] == [0]


def test_throttle_is_idempotent(spark):
    rng = random.Random(5)
    df = frame(spark, [(i, rng.randrange(10**7), "a", "x", True) for i in range(500)])
    once = throttle(df, F.col("identity"), F.col("us"), 100).where("accepted").drop("accepted")
    twice = throttle(once, F.col("identity"), F.col("us"), 100)
    assert twice.where("not accepted").count() == 0
    assert once.count() > 50


def test_long_windows_over_many_keys_do_not_overflow(spark):
    day = 86_400_000_000
    events = spark.range(40_000).select(
        (F.col("id") % 20_000).alias("k"), (F.col("id") * 7 % 11 * day).alias("us"),
        F.col("id").alias("eid"), F.lit(True).alias("may"),
    )
    kept = accepted_events(events, ["k"], 400 * day // 1000)
    assert kept.count() == 20_000
