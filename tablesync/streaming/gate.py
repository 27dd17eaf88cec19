"""The duplicate and echo gate as a keyed stateful stream.

State per (entity, identity): when each source was last accepted and last succeeded, and
the events that wait for the watermark, up to 4,096 of them in an entry of the list,
since each entry is written and read by itself. Events are decided in event-time order once the
watermark has passed them, so a stream gives what the batch job gives, in whatever order
the events arrive within the allowed delay.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

_COLUMNS = ["us", "event_id", "source", "may", "carry"]
_PACKED = 4096
# a run of waiting events: the earliest instant, then their columns
_EVENTS = (
    "first bigint, us array<bigint>, event_id array<bigint>, source array<string>, may array<boolean>, "
    "carry array<string>"
)
_MARKS = "seen_a bigint, seen_b bigint, ok_a bigint, ok_b bigint"
OUTPUT = (
    "entity string, identity string, event_id bigint, us bigint, source string, carry string, "
    "gate string"
)
_SHOWN = ["entity", "identity", "event_id", "us", "source", "carry", "gate"]


def _plain(column: pd.Series) -> list:
    """The values as Python ones, what is missing as None."""
    return [None if v != v else v for v in column.tolist()]


def _pack(events: list[tuple]) -> list[tuple]:
    """Entries of the waiting list."""
    runs = (events[at : at + _PACKED] for at in range(0, len(events), _PACKED))
    return [(min(e[0] for e in run), *map(list, zip(*run))) for run in runs]


class GateProcessor(StatefulProcessor):
    def __init__(self, window_ms: int):
        self.window = window_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", _MARKS)
        self.waiting = handle.getListState("waiting", _EVENTS)

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        for batch in rows:
            events = list(zip(*[_plain(batch[c]) for c in _COLUMNS]))
            self.waiting.appendList(_pack(events))
            self._wake_at(min(e[0] for e in events) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((e for entry in self.waiting.get() for e in zip(*entry[1:])), key=lambda e: e[:2])
        ready = [e for e in events if e[0] // 1000 <= now]
        later = events[len(ready):]
        if later:
            self.waiting.put(_pack(later))
            self._wake_at(later[0][0] // 1000)
        elif events:
            self.waiting.clear()
        marks = list(self.marks.get() or [None] * 4)
        gates = [self._decide(marks, *event) for event in ready]
        known = [m for m in marks if m is not None]
        if ready:
            self.marks.update(tuple(marks))
        # nothing older than twice the window can matter any more
        if known and not later:
            end = (max(known) + 2 * self.window) // 1000 + 1
            if end <= now:
                self.marks.clear()
            else:
                self._wake_at(end)
        if not ready:
            return iter(())
        us, ids, sources, _, carried = map(list, zip(*ready))
        entity, identity = ([k] * len(ready) for k in key)
        return iter([pd.DataFrame(dict(zip(_SHOWN, (entity, identity, ids, us, sources, carried, gates))))])

    def _wake_at(self, millis: int) -> None:
        self.handle.registerTimer(millis)

    def _decide(
        self, marks: list, us: int, event_id: int, source: str, may: bool, carry: str | None
    ) -> str | None:
        mine, other = (0, 1) if source == "a" else (1, 0)
        if marks[mine] is not None and us - marks[mine] < self.window:
            return "duplicate"
        marks[mine] = us
        done = marks[2 + other]
        if done is not None and us - done < self.window:
            return "echo"
        if may:
            marks[2 + mine] = us
        return None

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, window_ms: int, delay: str) -> DataFrame:
    """The events (event_id, ts, source, entity, identity, may, carry) with their gate.

    `carry` is any text that travels with the event. Events without an identity have no
    gate: union them in from the source with `ungated`.
    """
    keyed = events.where(F.col("identity").isNotNull()).select(
        "entity", "identity", "ts", F.unix_micros("ts").alias("us"),
        "event_id", "source", "may", "carry",
    )
    return (
        keyed.withWatermark("ts", delay)
        .groupBy("entity", "identity")
        .transformWithStateInPandas(
            statefulProcessor=GateProcessor(window_ms),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def ungated(events: DataFrame) -> DataFrame:
    return events.where(F.col("identity").isNull()).select(
        "entity", "identity", "event_id", F.unix_micros("ts").alias("us"), "source", "carry",
        F.lit(None).cast("string").alias("gate"),
    )
