"""Duplicate throttling and echo suppression over event tables.

Throttle: per key, an event is accepted when it lies at least T after the last
*accepted* one; duplicates do not move that anchor. This is a recursion over time, so
a plain window cannot express it, and one key may hold a third of all rows, so a fold
over the whole key must not run in one task either. One path serves every size:

1. rows of one key and one instant collapse to their first event (partial aggregate);
2. a range shuffle puts them in order, and every 2^`leaf_bits` places make a leaf: a run of
   instants of one key that a task can hold, however long T is or how dense the key;
3. first and last instant of a key's leaves bound where its chain of accepted events can
   be; leaves that it cannot touch are out of it;
4. what a leaf does to the anchor that enters it is a step function, and so is what several
   leaves in a row do. Functions are composed in a tree, 2^`fan_bits` at a time, and the
   anchors handed down it again: no task sees more than a few functions of a key;
5. the leaves are folded for good, all in parallel.

A function has a step per instant of the first T behind its beginning that the chain can
reach. Where T holds d instants of a key of n, that is at most d, and by step 3 at most
one leaf per window before it, n / d of them: never more than sqrt(n) x sqrt(leaf).

Echo suppression then works on the accepted events only (at most one per T and source)
with plain windows over (identity, time slice), see `echo_outcome`.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.session import stage

DEFAULT_WINDOW_MS = 500
LEAF_BITS = 15
FAN_BITS = 4
_NO_ANCHOR = -(1 << 63)

# --- vectorised kernels: run inside tasks on batches sorted by (key, leaf, time) ------


def _whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Re-cuts a sorted batch stream so that every table holds complete groups."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        start = _last_change(table, held[-1] if held else None, keys)
        if start is None:
            held.append(table)
            continue
        ready = held + ([table.slice(0, start)] if start else [])
        if ready:
            yield pa.concat_tables(ready).combine_chunks()
        held = [table.slice(start)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _differs(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """True at each row (but the first) whose key differs from the row before it."""
    changed = np.zeros(table.num_rows - 1, dtype=bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        changed |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(
            zero_copy_only=False
        )
    return changed


def _last_change(table: pa.Table, before: pa.Table | None, keys: tuple[str, ...]) -> int | None:
    inside = np.flatnonzero(_differs(table, keys)) if table.num_rows > 1 else np.array([])
    if len(inside):
        return int(inside[-1]) + 1
    if before is None:
        return None
    last = before.num_rows - 1
    same = all(before.column(k)[last].as_py() == table.column(k)[0].as_py() for k in keys)
    return None if same else 0


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Leaves:
    """The events of many (key, leaf) groups as one sorted axis, so that "the first
    event at or after x" is a single binary search for all groups at once."""

    def __init__(self, table: pa.Table, keys: tuple[str, ...], window: int):
        self.group = np.concatenate(([0], np.cumsum(_differs(table, (*keys, "leaf")))))
        self.us = _ints(table, "us")
        self.first = np.concatenate(([True], self.group[1:] != self.group[:-1]))
        # places instead of instants: group x places stays small however long a leaf is
        self.places = np.unique(self.us)
        self.axis = self._place(self.group, self.us)
        self.next = self.first_at(self.group, self.us + window)

    def _place(self, group: np.ndarray, us: np.ndarray) -> np.ndarray:
        return group * (len(self.places) + 1) + np.searchsorted(self.places, us, side="left")

    def first_at(self, group: np.ndarray, us: np.ndarray) -> np.ndarray:
        """The group's first row at or after an instant, -1 if there is none."""
        at = np.searchsorted(self.axis, self._place(group, us), side="left")
        inside = at < len(self.axis)
        inside[inside] = self.group[at[inside]] == group[inside]
        return np.where(inside, at, -1)

    def chain_ends(self, entries: np.ndarray) -> np.ndarray:
        """Last accepted row of the chain that starts at each entry row."""
        ends = entries.copy()
        live = np.arange(len(ends))
        while len(live):
            step = self.next[ends[live]]
            live, step = live[step >= 0], step[step >= 0]
            ends[live] = step
        return ends

    def accepted(self, starts: np.ndarray) -> np.ndarray:
        """All rows of the chains that start at the given rows."""
        taken = np.zeros(len(self.axis), dtype=bool)
        while len(starts):
            taken[starts] = True
            starts = self.next[starts]
            starts = starts[starts >= 0]
        return taken


def _reachable(lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """Which leaves of one key (first and last instants, in order) can hold an accepted event.

    Where an accepted event is known to lie in [low, high], the next one lies between the first
    instant from low + T on and the first known one from high + T on. The first instant behind
    a gap of T is accepted for certain. Once it can lie anywhere in a window, all leaves up to
    the next such gap can be touched; so every round here passes a leaf.
    """
    touched = np.zeros(len(lo), dtype=bool)
    starts = np.append(0, np.flatnonzero(lo[1:] >= hi[:-1] + window) + 1)
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(lo)).tolist()):
        low = high = int(lo[a])
        i = j = a
        while True:
            touched[i : j + 1] = True
            i = a + int(np.searchsorted(hi[a:b], low + window, side="left"))
            if i == b:
                break
            j = min(a + int(np.searchsorted(hi[a:b], high + window, side="left")), b - 1)
            low, high = max(low + window, int(lo[i])), int(lo[j]) if lo[j] >= high + window else int(hi[j])
            if high - low >= window:
                touched[i:b] = True
                break
    return touched


def _rank_leaves(keys: tuple[str, ...], window: int):
    """Leaves (lo, hi) of whole keys -> for keys with several leaves the `rank` of each one
    that the chain can touch, -1 of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, *keys):
            cuts = np.flatnonzero(_differs(table, keys)) + 1 if table.num_rows > 1 else np.array([], int)
            starts, ends = np.append(0, cuts), np.append(cuts, table.num_rows)
            lo, hi = _ints(table, "lo"), _ints(table, "hi")
            rows, ranks = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a > 1:
                    touched = _reachable(lo[a:b], hi[a:b], window)
                    rows.append(np.arange(a, b))
                    ranks.append(np.where(touched, np.cumsum(touched) - 1, -1))
            if rows:
                out = table.select([*keys, "leaf"]).take(pa.array(np.concatenate(rows)))
                yield from out.append_column("rank", pa.array(np.concatenate(ranks))).to_batches()

    return run


def _steps(entries: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Entries with the same exit are one step: true at the latest of each run."""
    keep = np.ones(len(entries), dtype=bool)
    keep[:-1] = exits[1:] != exits[:-1]
    return keep


def _leaf_functions(keys: tuple[str, ...], window: int):
    """Leaf -> its step function (lo, upto, exit): an anchor that allows events from x on leaves
    as the exit of the first step with upto >= x, and unchanged if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, *keys, "leaf"):
            c = _Leaves(table, keys, window)
            firsts = np.flatnonzero(c.first)
            lo = c.us[firsts]
            before = np.concatenate(([0], c.us[:-1]))
            entries = np.flatnonzero(c.first | (before < lo[c.group] + window))
            ends = c.chain_ends(entries)
            # rows of different leaves never share an exit
            keep = _steps(entries, ends)
            entries, ends = entries[keep], ends[keep]
            offsets = np.searchsorted(c.group[entries], np.arange(len(firsts) + 1)).astype(np.int32)
            out = table.select([*keys, "rank"]).take(pa.array(firsts))
            out = out.append_column("lo", pa.array(lo))
            for name, rows in (("upto", entries), ("exit", ends)):
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.us[rows]))
                out = out.append_column(name, lists)
            yield from out.to_batches()

    return run


def _functions(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    upto, exits = (table.column(c).combine_chunks() for c in ("upto", "exit"))
    return [(u.values.to_numpy(), e.values.to_numpy()) for u, e in zip(upto, exits)]


def compose(functions: list[tuple[np.ndarray, np.ndarray]], lo: int, window: int):
    """The step function of several in a row, whose first instant is lo."""
    upto, exits = functions[0]
    for u, e in functions[1:]:
        at = np.searchsorted(u, exits + window, side="left")
        exits = np.where(at < len(u), e[np.minimum(at, len(u) - 1)], exits)
        if upto[-1] < lo + window:  # anchors may pass by all so far
            upto, exits = np.concatenate([upto, u]), np.concatenate([exits, e])
    useful = np.concatenate(([True], upto[:-1] < lo + window))
    upto, exits = upto[useful], exits[useful]
    keep = _steps(upto, exits)
    return upto[keep], exits[keep]


def _composed(keys: tuple[str, ...], window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        lo = int(_ints(table, "lo")[0])
        upto, exits = compose(_functions(table), lo, window)
        head = table.select([*keys]).slice(0, 1)
        values = ("rank", int(_ints(table, "rank")[0]) >> bits), ("lo", lo)
        for name, value in values:
            head = head.append_column(name, pa.array([value], pa.int64()))
        for name, value in (("upto", upto), ("exit", exits)):
            head = head.append_column(name, pa.array([value], pa.list_(pa.int64())))
        return head

    return run


def _handed_down(keys: tuple[str, ...], window: int):
    """Functions in a row, with the anchor that enters the first -> the anchor entering each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        anchor = table.column("anchor")[0].as_py()
        entering = []
        for upto, exits in _functions(table):
            entering.append(anchor)
            at = 0 if anchor is None else int(np.searchsorted(upto, anchor + window, side="left"))
            anchor = int(exits[at]) if at < len(upto) else anchor
        out = table.select([*keys, "rank"])
        return out.append_column("anchor", pa.array(entering, pa.int64()))

    return run


def _fold(keys: tuple[str, ...], window: int):
    """Final fold: a row with a null `eid` before a leaf's events tells the anchor that enters
    it, or, with `may` false, that nothing in it can be accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, *keys, "leaf"):
            is_event = pc.is_valid(table.column("eid")).to_numpy()
            events = table.filter(pa.array(is_event))
            if events.num_rows == 0:
                continue
            c = _Leaves(events, keys, window)
            firsts = np.flatnonzero(c.first)
            position = np.flatnonzero(is_event)[firsts]
            told = np.maximum(position - 1, 0)
            has = (position > 0) & ~is_event[told]
            us, may = _ints(table, "us")[told], table.column("may").to_numpy()[told].astype(bool)
            begin = np.where(has & (us != _NO_ANCHOR), us + window, c.us[firsts])
            starts = c.first_at(c.group[firsts], begin)
            taken = c.accepted(starts[(starts >= 0) & (~has | may)])
            if taken.any():
                yield from events.filter(pa.array(taken)).drop_columns(["leaf"]).to_batches()

    return run


# --- operators ---------------------------------------------------------------------


def floor_div(column: str, length: int) -> Column:
    """Floor division in whole numbers, also for negative time."""
    return F.expr(f"({column} - pmod({column}, {length}L)) div {length}L")


def _in_groups(df: DataFrame, group: Sequence[str], *order: str) -> DataFrame:
    """Rows of a group in one partition, next to each other and in order.

    A repartition by columns is never split by adaptive execution, only coalesced.
    """
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def _entering(functions: DataFrame, keys: Sequence[str], window: int, leaves: int, bits: int) -> DataFrame:
    """(keys, rank, anchor): the anchor that enters each of a key's leaves, by a tree over their
    functions. Its height follows from the most leaves that a key has."""
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in functions.select(*keys).schema.fields]
    function = ", ".join([*named, "rank long, lo long, upto array<long>, exit array<long>"])
    anchored = ", ".join([*named, "rank long, anchor long"])
    above = F.shiftright("rank", bits)
    levels = [functions]
    while leaves > 1 << bits:
        grouped = levels[-1].groupBy(*keys, above.alias("_above"))
        levels.append(stage(grouped.applyInArrow(_composed(tuple(keys), window, bits), function), "functions"))
        leaves = -(-leaves // (1 << bits))
    entering = None
    for level in reversed(levels):
        level = level.withColumn("_above", above)
        if entering is None:
            level = level.withColumn("anchor", F.lit(None).cast("long"))
        else:
            level = level.join(entering.withColumnRenamed("rank", "_above"), [*keys, "_above"])
        entering = stage(
            level.groupBy(*keys, "_above").applyInArrow(_handed_down(tuple(keys), window), anchored), "anchors"
        )
    return entering


def accepted_events(
    events: DataFrame,
    keys: Sequence[str],
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    leaf_bits: int = LEAF_BITS,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """(keys, us, eid, may) of the accepted events, for events with those columns.

    Events with a null key are not throttled and not returned.
    """
    slim = events.select(*keys, "us", "eid", "may").dropna(subset=list(keys))
    window = window_ms * 1000
    if window <= 0:
        return slim
    # plain minima, so that the aggregate hashes instead of sorting: the first event of
    # an instant may succeed if it is also the first of those that may
    slim = (
        slim.groupBy(*keys, "us")
        .agg(F.min("eid").alias("eid"), F.min(F.when(F.col("may"), F.col("eid"))).alias("_m"))
        .select(
            *keys,
            "us",
            "eid",
            F.coalesce(F.col("_m") == F.col("eid"), F.lit(False)).alias("may"),
        )
    )
    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    named = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    names, leaf = tuple(keys), [*keys, "leaf"]
    placed = stage(
        slim.repartitionByRange(*keys, "us")
        .sortWithinPartitions(*keys, "us")
        .withColumn("leaf", F.shiftright(F.monotonically_increasing_id(), leaf_bits)),
        "instants",
    )
    ends = placed.groupBy(*leaf).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    ranked = stage(
        _in_groups(ends, keys, "leaf").mapInArrow(_rank_leaves(names, window), f"{named}, leaf long, rank long"),
        "leaves",
    )
    touched = ranked.where("rank >= 0")
    functions = stage(
        _in_groups(placed.join(touched, leaf), leaf, "us").mapInArrow(
            _leaf_functions(names, window), f"{named}, rank long, lo long, upto array<long>, exit array<long>"
        ),
        "functions",
    )
    leaves = (touched.agg(F.max("rank")).first()[0] or 0) + 1
    entering = _entering(functions, keys, window, leaves, fan_bits)
    told = ranked.join(entering, [*keys, "rank"], "left").select(
        *keys, F.coalesce("anchor", F.lit(_NO_ANCHOR)).alias("us"), F.lit(None).cast("long").alias("eid"),
        (F.col("rank") >= 0).alias("may"), "leaf",
    )
    folded = _in_groups(placed.unionByName(told), leaf, "us")
    return folded.mapInArrow(_fold(names, window), f"{named}, us long, eid long, may boolean")


def echo_outcome(
    accepted: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    slice_windows: int = 4096,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(eid, echo) for accepted events (us, eid, source, identity, may), and the columns of
    these named in `keep`.

    An event is an echo if the other side successfully synced the same record less
    than T before it. Accepted events of one source lie at least T apart, so the only
    success that can matter is that of the event right before. With "linked" = right
    after an event of the other source, less than T later, that may succeed:
    success_i = may_i and not (linked_i and success_i-1), so within a run of linked
    events success simply alternates.

    Windows run per (identity, time slice), so a hot identity spreads over many tasks.
    The rows less than T before a border are repeated in the next slice as context, and
    the few runs that do cross a border take their parity from a pass over the slices.
    """
    window_us = window_ms * 1000
    if window_us <= 0:
        return accepted.select("eid", F.lit(False).alias("echo"), *keep)
    length = window_us * slice_windows
    home = floor_div("us", length)
    near_end = F.expr(f"pmod(us, {length}L) >= {length - window_us}L")
    spread = accepted.where(F.col("identity").isNotNull()).select(
        "identity", "source", "us", "eid", "may",
        F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))).alias("part"),
    )
    in_part = W.partitionBy("identity", "part").orderBy("us", "eid")
    rows = (
        spread.withColumn("prev", F.lag(F.struct("us", "source", "may")).over(in_part))
        .withColumn("own", floor_div("us", length) == F.col("part"))
        .withColumn(
            "linked",
            F.coalesce(
                (F.col("prev.source") != F.col("source"))
                & (F.col("us") - F.col("prev.us") < window_us)
                & F.col("prev.may"),
                F.lit(False),
            ),
        )
        .where("own")
        .withColumn("head", F.row_number().over(in_part) == 1)
        .withColumn("run", F.sum(F.when(F.col("linked") & ~F.col("head"), 0).otherwise(1)).over(in_part))
        .withColumn(
            "pos",
            F.row_number().over(W.partitionBy("identity", "part", "run").orderBy("us", "eid")) - 1,
        )
    )
    per_part = (
        rows.groupBy("identity", "part")
        .agg(
            F.count_if(F.col("run") == 1).alias("n"),
            F.bool_or(F.col("head") & F.col("linked")).alias("joined"),
            F.max("run").alias("runs"),
            F.max(F.struct("us", "eid", "pos")).alias("tail"),
        )
        # only parts that take a run from before, or can hand one on
        .where(
            F.col("joined")
            | F.expr(f"pmod(tail.us, {length}L) >= {length - window_us}L")
        )
        .withColumn("passes", F.col("joined") & (F.col("runs") == 1))
    )
    in_order = W.partitionBy("identity").orderBy("part")
    carried = (
        per_part.withColumn("section", F.sum(F.when(F.col("passes"), 0).otherwise(1)).over(in_order))
        .withColumn("size", F.when(F.col("passes"), F.col("n")).otherwise(F.col("tail.pos") + 1))
        .withColumn(
            "total",
            F.sum("size").over(W.partitionBy("identity", "section").orderBy("part")),
        )
        .withColumn("carry", F.lag("total").over(in_order))
        .where("joined")
        .select("identity", "part", F.lit(1).alias("run"), "carry")
    )
    placed = rows.join(carried, ["identity", "part", "run"], "left")
    return placed.select(
        "eid", ((F.col("pos") + F.coalesce("carry", F.lit(0))) % 2 == 1).alias("echo"), *keep
    )


def gate_outcome(
    events: DataFrame,
    *,
    entity: str = "entity",
    source: str = "source",
    identity: str = "identity",
    micros: str = "us",
    id_col: str = "event_id",
    may_succeed: Column | None = None,
    window_ms: int = DEFAULT_WINDOW_MS,
    slice_windows: int = 4096,
    **tree: int,
) -> DataFrame:
    """Adds `gate`: null (goes on), 'duplicate' or 'echo'. No identity, no gate."""
    slim = _slim(events, entity, source, identity, micros, id_col, may_succeed)
    accepted = accepted_events(slim, ["source", "identity"], window_ms, **tree)
    echoes = echo_outcome(accepted, window_ms, slice_windows=slice_windows)
    joined = events.join(echoes, events[id_col] == echoes["eid"], "left")
    return joined.withColumn("gate", _gate(identity)).drop("eid", "echo")


def _slim(events, entity, source, identity, micros, id_col, may_succeed) -> DataFrame:
    may = F.lit(True) if may_succeed is None else F.coalesce(may_succeed, F.lit(False))
    return events.select(
        F.col(source).alias("source"),
        F.concat(F.col(entity), F.lit(":"), F.col(identity)).alias("identity"),
        F.col(micros).alias("us"),
        F.col(id_col).alias("eid"),
        may.alias("may"),
    )


def _gate(identity: str) -> Column:
    return (
        F.when(F.col(identity).isNull(), None)
        .when(F.col("eid").isNull(), "duplicate")
        .when(F.col("echo"), "echo")
    )


MARKS = "source string, identity string, us bigint, eid bigint, may boolean"


def gate_step(
    events: DataFrame,
    marks: DataFrame,
    *,
    entity: str = "entity",
    may_succeed: Column | None = None,
    window_ms: int = DEFAULT_WINDOW_MS,
    **options: int,
) -> tuple[DataFrame, DataFrame]:
    """The gate of events that all lie behind those of earlier steps: (events with their `gate`,
    marks for the next step).

    A mark is the last accepted event of a source and identity; `may` tells whether it
    succeeded. It goes first among the events of its key, where it is accepted as it was
    before. An earlier success of that source lies T before the mark at least and cannot
    matter any more.
    """
    slim = _slim(events, entity, "source", "identity", "us", "event_id", may_succeed)
    accepted = accepted_events(slim.unionByName(marks), ["source", "identity"], window_ms)
    echoes = stage(
        echo_outcome(accepted, window_ms, keep=("source", "identity", "us", "may"), **options), "echoes"
    )
    # a mark may share its event id with a later delivery, but not its instant
    mine = echoes.select("eid", "echo", F.col("us").alias("_us"))
    joined = events.join(mine, (events["event_id"] == mine["eid"]) & (events["us"] == mine["_us"]), "left")
    last = F.max_by(F.struct("us", "eid", (F.col("may") & ~F.col("echo")).alias("may")), F.col("us"))
    after = echoes.groupBy("source", "identity").agg(last.alias("m")).select("source", "identity", "m.*")
    return joined.withColumn("gate", _gate("identity")).drop("eid", "echo", "_us"), after


def throttle(
    events: DataFrame,
    key: Column,
    micros: Column,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    id_col: str = "event_id",
    **tree: int,
) -> DataFrame:
    """Adds the `accepted` flag; events without a key are never duplicates.

    The flag comes back by a join on the event id, which is unique, so a hot key makes
    no hot partition there.
    """
    slim = events.select(
        key.alias("k"), micros.alias("us"), F.col(id_col).alias("eid"), F.lit(True).alias("may")
    )
    ids = accepted_events(slim, ["k"], window_ms, **tree).select("eid")
    joined = events.join(ids, events[id_col] == ids["eid"], "left")
    return joined.withColumn("accepted", key.isNull() | F.col("eid").isNotNull()).drop("eid")


def state_stats(outcomes: DataFrame, now_us: Column, window_ms: int = DEFAULT_WINDOW_MS) -> DataFrame:
    """How many keys the throttle and echo state would hold at `now`, per source.

    A throttle entry lives for 2T after its last accepted event, a sync entry for T.
    """
    who = F.struct("entity", "identity")
    age = now_us - F.col("us")
    passed = F.coalesce(F.col("gate") != "duplicate", F.lit(True)) & F.col("identity").isNotNull()
    done = F.col("gate").isNull() & F.col("identity").isNotNull()
    return outcomes.groupBy("source").agg(
        F.count_if(passed).alias("accepted_events"),
        F.count_if(F.col("gate") == "duplicate").alias("duplicates"),
        F.count_if(F.col("gate") == "echo").alias("echoes"),
        F.count_distinct(F.when(passed & (age <= 2000 * window_ms), who)).alias("active_keys"),
        F.count_distinct(F.when(done & (age < 1000 * window_ms), who)).alias("synced_keys"),
    )
