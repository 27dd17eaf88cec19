"""What the stateful gate keeps: run against states and timers held in plain objects."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from tablesync.streaming.gate import GateProcessor

WINDOW_MS = 500


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Waiting:
    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows

    def clear(self):
        self.held = []


class Stream:
    """One key: batches of events, then the timers that the new watermark has passed."""

    def __init__(self):
        self.marks, self.waiting, self.timers = Value(), Waiting(), set()
        handle = SimpleNamespace(
            getValueState=lambda *_: self.marks,
            getListState=lambda *_: self.waiting,
            registerTimer=self.timers.add,
        )
        self.gate = GateProcessor(WINDOW_MS)
        self.gate.init(handle)

    def push(self, events, watermark):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        out = []
        if events:
            frame = pd.DataFrame(events, columns=["us", "event_id", "source", "may", "carry"])
            list(self.gate.handleInputRows(("e", "i"), iter([frame]), now))
        while due := sorted(t for t in self.timers if t <= watermark):
            self.timers.discard(due[0])
            for frame in self.gate.handleExpiredTimer(("e", "i"), now, due[0]):
                out += zip(frame["event_id"], frame["gate"])
        return out


def test_marks_leave_twice_the_window_after_the_last_event():
    stream = Stream()
    assert stream.push([(1_000_000, 1, "a", True, None), (1_200_000, 2, "a", True, None)], 0) == []
    assert stream.push([], 1_300) == [(1, None), (2, "duplicate")]
    assert stream.marks.exists() and not stream.waiting.held
    assert stream.push([], 1_999) == [] and stream.marks.exists()
    assert stream.push([], 2_001) == []
    assert not stream.marks.exists() and not stream.timers
    assert stream.push([(9_000_000, 3, "b", True, None)], 9_100) == [(3, None)]


def test_marks_stay_while_events_within_the_window_wait():
    stream = Stream()
    stream.push([(1_000_000, 1, "a", True, None), (1_450_000, 2, "b", True, None)], 0)
    assert stream.push([], 1_100) == [(1, None)]
    assert stream.marks.exists() and len(stream.waiting.held) == 1
    assert stream.push([], 1_500) == [(2, "echo")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_holds_no_more_than_the_open_events(seed):
    """However many batches pass, only events ahead of the watermark wait, and all are decided once."""
    rng = random.Random(seed)
    stream, decided, sent, at = Stream(), [], [], 0
    for batch in range(200):
        at += rng.choice([40, 700, 3_000])
        events = [
            ((at + rng.randrange(400)) * 1000, 10 * batch + i, rng.choice("ab"), rng.random() < 0.8, None)
            for i in range(rng.randrange(6))
        ]
        decided += stream.push(events, at)
        assert all(us // 1000 > at for us, *_ in stream.waiting.held) and len(stream.waiting.held) <= 6 * 11
        assert len(stream.timers) <= 6 * 11 + 1
        sent += [e[1] for e in events]
    decided += stream.push([], at + 10_000)
    assert sorted(i for i, _ in decided) == sent
    assert not stream.waiting.held and not stream.marks.exists() and not stream.timers


def test_waiting_events_share_entries_and_keep_their_order():
    """Ten thousand events that wait are a few entries, and all of them come out in the order of time."""
    stream = Stream()
    events = [(1_000_000 + 1_000 * (i * 7 % 10_000), i, "ab"[i % 2], True, None) for i in range(10_000)]
    assert stream.push(events, 0) == []
    assert len(stream.waiting.held) <= 3
    first = stream.push([], 6_000)
    assert len(first) == 5_001 and len(stream.waiting.held) <= 2
    both = first + stream.push([], 20_000)
    assert [i for i, _ in both] == [e[1] for e in sorted(events)]
    plain = Stream()
    assert both == plain.push(events, 20_000)
    assert not stream.waiting.held
