import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from tests.llm import brute
from tablesync.llm import repair
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, first string, place int"
WHITE = " \t\n\x0b\x0c\r"


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        words = text.strip(WHITE)
        if not words:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, marks):
    """All edits, state by state: (cost, audit, lines) of the initials said so far."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for at, (cost, audit, lines) in list(states.items()):
                for c in after[at]:
                    if c != "s":
                        offer(states, c, cost + 3, audit + "I", (*lines, ("user:" if c == "u" else "assistant:")))
        return states

    def offer(states, at, *way):
        if at not in states or way[:2] < states[at][:2]:
            states[at] = way

    for (_, role, text), mark in zip(turns, marks):
        new = {}
        # with an insert or without: both stay open, since a longer audit may be the lesser one
        for some in (states, inserted(dict(states))):
            for at, (cost, audit, lines) in some.items():
                offer(new, at, cost + 4, audit + "D", lines)
                if mark in ("blank", "duplicate"):
                    continue
                more = 3 if mark == "truncated" else 0
                if role[:1] and role[:1] in after[at]:
                    offer(new, role[:1], cost + more, audit + "K", (*lines, f"{role}:{text}"))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in after[at]:
                        offer(new, c, cost + more + 3, audit + "R", (*lines, f"{name}:{text}"))
        states = new
    states = inserted(states)
    return min((states[at] for at in ("", "a") if at in states), key=lambda way: way[:2])


def expected(rows):
    given = [(t, *(" " if v is None else v for v in said)) for t, *said in rows]
    turns = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marks = faults(turns)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, lines = cheapest(turns, marks) if turns else (0, "", ())
    counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got_of(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def run(spark, rows):
    given = frame(spark, rows)
    return got_of(repair.summaries(given, repair.repair(given)))


def by_conversation(rows):
    out = {}
    for conv_id, *rest in rows:
        out.setdefault(conv_id, []).append(tuple(rest))
    return out


def test_alignment_of_every_short_signature():
    letters = [c + k for c in "suax" for k in "ktd"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(1, 4):
        for codes in itertools.product(letters, repeat=n):
            turns = [(i, names[c[0]], f"t{i}") for i, c in enumerate(codes)]
            marks = [{"k": "", "t": "truncated", "d": "blank"}[c[1]] for c in codes]
            cost, audit, _ = cheapest(turns, marks)
            ways = [(c + repair._CLOSING[x][2], a + repair._CLOSING[x][0]) for e, x, c, a, _ in repair.align("".join(codes)) if e == 0]
            assert min(ways) == (cost, audit), codes


def test_alignment_of_long_random_signatures():
    rng = random.Random(3)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(150):
        codes = [rng.choice("uuuaaasx") + rng.choice("kkkktd") for _ in range(rng.randrange(4, 64))]
        turns = [(i, names[c[0]], f"t{i}") for i, c in enumerate(codes)]
        marks = [{"k": "", "t": "truncated", "d": "blank"}[c[1]] for c in codes]
        cost, audit, _ = cheapest(turns, marks)
        ways = [(c + repair._CLOSING[x][2], a + repair._CLOSING[x][0]) for e, x, c, a, _ in repair.align("".join(codes)) if e == 0]
        assert min(ways) == (cost, audit), codes
        assert re.fullmatch("[DIKR]*", audit)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "no end"),
        (2, None, None, None), (2, None, "", "x."), (2, 3, "User", "x."), (None, 1, "assistant", "Lost."),
        (None, None, "system", "S."), (3, 1, "system", "S."), (3, 2, "tool", "T."), (4, 1, "user", ""),
        (5, 1, "s", "A."), (5, 2, "s", "B."), (5, 3, "u", "C! \n"), (6, 1, "user", "long " * 60_000 + "."),
        (6, 2, "assistant", " " * 100_000 + "."), (7, None, "assistant", "One."), (7, None, "user", "Two."),
    ]
    want = {conv_id: expected(turns) for conv_id, turns in by_conversation(rows).items()}
    assert run(spark, rows) == want
    empty = frame(spark, [])
    assert repair.summaries(empty, repair.repair(empty)).count() == 0


def test_text_numbers_of_conversations(spark):
    given = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "user", "Ho.")], "conv_id string, turn int, role string, text string")
    assert {k: v[5:7] for k, v in got_of(repair.summaries(given, repair.repair(given))).items()} == {"a": (3, "KI"), "b": (3, "KI")}


def test_one_conversation_over_many_chunks_and_tasks(spark):
    rng = random.Random(11)
    rows = [(1, rng.randrange(2500), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"w{i}.", f"v{i}"])) for i in range(3000)]
    rows += [(i, t, rng.choice(["user", "assistant"]), f"{t}.") for i in range(2, 40) for t in range(rng.randrange(1, 9))]
    want = {conv_id: expected(turns) for conv_id, turns in by_conversation(rows).items()}
    assert run(spark, rows) == want
    found = repair.repair(frame(spark, rows))
    assert found.edits.filter("conv_id = 1").count() > 40


def damaged_rows(rows):
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        draw = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * (2 if draw == 3 else 1)


def test_damage(spark):
    rows = [(i if i % 7 else None, t if t % 5 else None, "assistant" if t % 3 else None, f"T{t}. Yes!" if t % 4 else None) for i in range(40) for t in range(9)]
    got = sorted((tuple(r) for r in repair.damaged(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(damaged_rows(rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(damaged_rows(rows))
    want = {conv_id: expected(left.get(conv_id, [])) for conv_id in {r[0] for r in rows}}
    assert got_of(QUERIES["op11_repair"](spark, FOLDER)) == want
    assert brute.sha("") == hashlib.sha256(b"").hexdigest()
