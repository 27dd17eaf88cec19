"""Conversation structure repair: the cheapest edits that make the turns of a conversation
alternate, found by aligning them with every feasible length of the alternating string.

A conversation is cut into chunks of at most 64 turns, so that one of any length is spread
over the tasks. A chunk is aligned once per state in which it can be entered and left; the
chunks of a conversation are then chained by a few numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import sha256, texts
from tablesync.session import stage

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_WHITE = " \t\n\x0b\x0c\r"
_CHUNK_BITS = 6
_NEVER = 1 << 40
_SIGNATURES = 200_000

# States between turns: nothing said yet, after the system's turn, after the user's, after
# the assistant's. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {"u": "user", "a": "assistant"}
#: letters, roles and cost of the inserts that complete a conversation left in a state
_CLOSING = {START: ("", "", 0), SYSTEM: ("II", "ua", 2 * INSERT), USER: ("I", "a", INSERT), ASSISTANT: ("", "", 0)}


def _blank(text: Column) -> Column:
    return _trimmed(text) == ""


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_WHITE))


def damaged(conversations: DataFrame) -> DataFrame:
    """The given turns (conv_id, turn, role, text), damaged by a hash of number and turn: left out,
    emptied, without ends of sentences, repeated, or given to the user. Null role or text
    reads as one space, as does a null number or turn in the hash."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        conversations.withColumn("_draw", draw)
        .filter("_draw <> 0")
        .select(
            "conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"),
            text.alias("text"), F.explode(times).alias("_time"),
        )
        .drop("_time")
    )


def _greedy(classes: str, kinds: str) -> int:
    """What a single pass costs: the incumbent that bounds the alignment."""
    cost, want = 0, "u"
    for c, kind in zip(classes, kinds):
        if kind == "d":
            cost += DELETE
            continue
        stays = TRUNCATED if kind == "t" else 0
        if c == want:
            cost += stays
            want = "a" if want == "u" else "u"
        elif c in "ua":
            cost += stays + INSERT
        else:
            cost += DELETE
    return cost


class _Alignment:
    """Wagner-Fischer matrix of a chunk against all strings that end with one role: cell (i, k) is
    the least cost of turning the turns from i on into the last k letters, the last of which
    a turn has to take or be deleted behind. Cells whose difference in length alone costs
    more than the incumbent are never computed (Ukkonen's band)."""

    def __init__(self, classes: str, kinds: str, last: str, most: int):
        self.classes, self.kinds, self.last = classes, kinds, last
        n = len(classes)
        self.longest = n + most // INSERT
        self.cells = [[_NEVER] * (self.longest + 1) for _ in range(n + 1)]
        self.cells[n][0] = 0
        fewer, more = most // DELETE, most // INSERT
        for i in range(n - 1, -1, -1):
            here, below, left = self.cells[i], self.cells[i + 1], n - i
            for k in range(max(0, left - fewer), min(self.longest, left + more) + 1):
                best = below[k] + DELETE
                if k:
                    _, cost = self.meet(i, k)
                    best = min(best, here[k - 1] + INSERT, below[k - 1] + cost)
                here[k] = min(best, _NEVER)

    def letter(self, k: int) -> str:
        """The k-th letter from the end."""
        return self.last if k % 2 else ("u" if self.last == "a" else "a")

    def meet(self, i: int, k: int) -> tuple[str, int]:
        """Turn i takes the k-th letter from the end: kept or with a new role."""
        if self.kinds[i] == "d":
            return "", _NEVER
        stays = TRUNCATED if self.kinds[i] == "t" else 0
        return ("K", stays) if self.classes[i] == self.letter(k) else ("R", stays + REROLE)

    def least(self, i: int, k: int) -> tuple[str, str]:
        """The ASCII-least of the cheapest audits from cell (i, k), and the roles it gives."""
        audit: list[str] = []
        roles: list[str] = []
        n, cells = len(self.classes), self.cells
        while i < n:
            cost = cells[i][k]
            if cells[i + 1][k] + DELETE == cost:
                step, role, i = "D", "-", i + 1
            elif k and cells[i][k - 1] + INSERT == cost:
                step, role, k = "I", self.letter(k), k - 1
            else:
                step, _ = self.meet(i, k)
                role, i, k = "-" if step == "K" else self.letter(k), i + 1, k - 1
            audit.append(step)
            roles.append(role)
        return "".join(audit), "".join(roles)


@lru_cache(maxsize=_SIGNATURES)
def align(signature: str) -> tuple[tuple[int, int, int, str, str], ...]:
    """signature: class (s, u, a, x) and kind (k sound, t truncated, d to be deleted) of each turn
    -> (entry state, exit state, cost, audit, roles) of each pair of states.

    Every feasible length is tried: those whose difference in length costs no more than the
    incumbent. Of equal costs the backtraced audits are compared.
    """
    classes, kinds = signature[::2], signature[1::2]
    n = len(classes)
    # any pair of states costs at most one deletion and three inserts more than the pass
    most = _greedy(classes, kinds) + DELETE + 3 * INSERT
    found: dict[tuple[int, int], tuple[int, str, str]] = {}

    def offer(entry: int, leave: int, cost: int, audit: str, roles: str) -> None:
        if (entry, leave) not in found or (cost, audit) < found[entry, leave][:2]:
            found[entry, leave] = cost, audit, roles

    for state in range(4):
        offer(state, state, n * DELETE, "D" * n, "-" * n)
    kept = [(i, TRUNCATED if kinds[i] == "t" else 0) for i in range(n) if classes[i] == "s" and kinds[i] != "d"]
    for i, stays in kept:  # the system's turn alone
        offer(START, SYSTEM, (n - 1) * DELETE + stays, "D" * i + "K" + "D" * (n - i - 1), "-" * n)
    for leave, last in ((USER, "u"), (ASSISTANT, "a")):
        matrix = _Alignment(classes, kinds, last, most)
        for k in range(1, matrix.longest + 1):
            entries = (USER,) if matrix.letter(k) == "a" else (START, SYSTEM, ASSISTANT)
            cost = matrix.cells[0][k]
            if cost < _NEVER:
                open_to = [e for e in entries if (e, leave) not in found or cost <= found[e, leave][0]]
                if open_to:
                    audit, roles = matrix.least(0, k)
                    for entry in open_to:
                        offer(entry, leave, cost, audit, roles)
            if START in entries:
                for i, stays in kept:  # the system's turn first, whatever is before it deleted
                    cost = i * DELETE + stays + matrix.cells[i + 1][k]
                    if cost < _NEVER and ((START, leave) not in found or cost <= found[START, leave][0]):
                        audit, roles = matrix.least(i + 1, k)
                        offer(START, leave, cost, "D" * i + "K" + audit, "-" * (i + 1) + roles)
    return tuple((e, x, *rest) for (e, x), rest in sorted(found.items()))


def _illegal(classes: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(classes, classes[1:]))


_TABLE = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("entry", "leave", "cost")]
        + [T.StructField(n, T.StringType()) for n in ("audit", "roles")]
    )
)


def _aligned(chunks: DataFrame) -> DataFrame:
    """Each chunk (conv_id, first, signature) with its table of states."""
    schema = T.StructType(chunks.schema.fields + [T.StructField("ways", _TABLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _TABLE.elementType.names
        kinds = [pa.int32()] * 3 + [pa.string()] * 2
        kind = pa.list_(pa.struct(list(zip(names, kinds))))
        for batch in batches:
            ways = [[dict(zip(names, w)) for w in align(s.as_py())] for s in batch.column("signature")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], names=schema.names)

    return chunks.mapInArrow(run, schema)


def _chained(aligned: DataFrame) -> DataFrame:
    """The way each chunk takes in its whole conversation.

    Chunks come from the last to the first of a conversation, one at a time: four costs and what
    was chosen per state are kept. Audits of one chunk and entry that leave it in different
    states differ before either ends, so the chunk's own audits settle ties of the whole.
    """
    schema = T.StructType(
        [aligned.schema["conv_id"], aligned.schema["first"]]
        + [T.StructField(n, T.LongType()) for n in ("cost", "illegal")]
        + [T.StructField(n, T.StringType()) for n in ("audit", "roles")]
    )

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.select(["conv_id", "first", "signature", "ways"]).to_pylist()

    def chain(conv_id, chunks: Iterator[dict]) -> Iterator[tuple]:
        ahead = {state: closing[2] for state, closing in _CLOSING.items()}
        chosen, behind = [], ""
        for chunk in chunks:
            best: dict[int, tuple] = {}
            for w in chunk["ways"]:
                if w["leave"] not in ahead:
                    continue
                rank = w["cost"] + ahead[w["leave"]], w["audit"]
                if w["entry"] not in best or rank < best[w["entry"]][0]:
                    best[w["entry"]] = rank, w["leave"], w["cost"], w["audit"], w["roles"]
            classes = chunk["signature"][::2]
            chosen.append((chunk["first"], _illegal(classes + behind), {e: b[1:] for e, b in best.items()}))
            ahead, behind = {e: b[0][0] for e, b in best.items()}, classes[0]
        state = START
        for nth, (first, illegal, take) in enumerate(reversed(chosen), 1):
            state, cost, audit, roles = take[state]
            if nth == len(chosen):
                letters, more, closing = _CLOSING[state]
                audit, roles, cost = audit + letters, roles + more, cost + closing
            yield conv_id, first, cost, illegal, audit, roles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for conv_id, chunks in groupby(ways(batches), key=lambda c: c["conv_id"]):
            for row in chain(conv_id, chunks):
                held.append(row)
                if len(held) == 1000:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    kinds = pa.schema([("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
    key_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[aligned.schema["conv_id"].dataType.simpleString()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [key_kind, pa.int64(), *kinds.types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    together = aligned.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
    return together.mapInArrow(run, schema)


class Repair:
    """What `repair` found: `faults` (conv_id, blank, duplicate, truncated, gaps), `edits` (conv_id,
    first, cost, illegal, audit, roles; one row per chunk, by `first`), `turns` (conv_id,
    first, nth, action, role, text: the repaired turns in order)."""

    def __init__(self, faults: DataFrame, edits: DataFrame, turns: DataFrame):
        self.faults, self.edits, self.turns = faults, edits, turns


def repair(conversations: DataFrame) -> Repair:
    """Edits conversations (conv_id, turn, role, text) so that the initials of their roles read as
    an optional system turn and pairs of user and assistant.

    Turns are ordered by number, null first, equal numbers by role and text. A turn without a
    word is blank; else one whose role and text were there before is a duplicate; else one
    whose last character is no end of a sentence is truncated. Blank and duplicate turns have
    to go. A null role or text reads as one space; a role is known by its first character, and one that
    is not s, u or a (nor one without any) cannot stay as it is. Turns without conv_id are one
    conversation. conv_id is a long, an int or a string. Repeated rows are duplicates. Empty
    table: no rows. Other columns, whatever their names, are not looked at. Texts of any length
    are moved twice and never gathered.

    Turns get their places by a range shuffle, so that one conversation may fill many tasks.
    """
    given = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    begins = F.substring("text", 1, 32)  # the same order as the text's, for the range alone
    placed = stage(
        given.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", begins)
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
        .select("*", F.monotonically_increasing_id().alias("place")),
        "turns",
    )
    said = (F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text"))
    end = F.right(_trimmed(F.col("text")), F.lit(1))
    rows = placed.select(
        "conv_id", "turn", "place", said[0].alias("h1"), said[1].alias("h2"),
        F.substring("role", 1, 1).alias("initial"), _blank(F.col("text")).alias("blank"),
        (~end.isin(".", "!", "?")).alias("open"),
    )
    first = rows.groupBy("conv_id", "h1", "h2").agg(F.min("place").alias("place")).select("place", F.lit(1).alias("new"))
    kind = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "r").when(F.col("open"), "t").otherwise("k")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    judged = stage(
        rows.join(first, "place", "left").select("conv_id", "turn", "place", kind.alias("kind"), known.alias("class")), "judged"
    )
    by_turn = judged.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("b", "blank"), ("r", "duplicate"), ("t", "truncated"))]
    )
    faults = by_turn.groupBy("conv_id").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    code = F.concat("class", F.when(F.col("kind").isin("b", "r"), "d").otherwise(F.col("kind")))
    chunks = (
        judged.groupBy("conv_id", F.shiftright("place", _CHUNK_BITS).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("place", code.alias("code")))).alias("turns"))
        .select("conv_id", F.col("turns")[0]["place"].alias("first"), F.array_join(F.col("turns.code"), "").alias("signature"))
    )
    edits = stage(_chained(_aligned(chunks)), "edits")
    # letters that take a turn, before and including each letter: the places of a chunk are contiguous
    nth = F.posexplode(F.split("audit", "")).alias("nth", "action")
    letters = edits.select("conv_id", "first", "audit", "roles", nth).filter("action in ('K', 'R', 'I')")
    role = F.substr(F.col("roles"), F.col("nth") + 1, F.lit(1))
    named = letters.select(
        "conv_id", "first", "nth", "action",
        F.when(role == "u", _ROLES["u"]).when(role == "a", _ROLES["a"]).alias("new_role"),
        (F.col("first") + F.char_length(F.replace(F.substr("audit", F.lit(1), F.col("nth")), F.lit("I"), F.lit("")))).alias("place"),
    )
    taken = named.filter("action <> 'I'").join(placed.select("place", "role", "text"), "place")
    keys = ["conv_id", "first", "nth", "action"]
    turns = taken.select(*keys, F.coalesce("new_role", "role").alias("role"), "text").unionByName(
        named.filter("action = 'I'").select(*keys, F.col("new_role").alias("role"), F.lit("").alias("text"))
    )
    return Repair(faults, edits, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the repaired turns as role:text lines. A hash over a whole
    conversation is sequential by definition; its lines pass one task as a stream, sorted on
    disk, and are never held together."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column("conv_id"), texts(batch, "line"))

        for conv_id, found in groupby(lines(), key=lambda pair: pair[0]):
            state = hashlib.sha256(next(found)[1])
            for _, line in found:
                state.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv_id.as_py()], conv_id.type), pa.array([state.hexdigest()])], names=schema.names
            )

    together = turns.select("conv_id", "first", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", "first", "nth").select("conv_id", "line")
    return ordered.mapInArrow(run, schema)


def summaries(conversations: DataFrame, found: Repair) -> DataFrame:
    """One row per conversation of the table `conversations`: its faults, the cost and the letters of
    its edits, and the hash of what was made of it. One without any turns left before the
    repair has zeros, an empty audit and the hash of nothing."""
    audits = found.edits.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("first", "audit")))["audit"], "").alias("audit"),
    )
    out = conversations.select("conv_id").distinct()
    for part in (found.faults, audits, digests(found.turns)):
        part = part.withColumnRenamed("conv_id", "_id")
        out = out.join(part, out["conv_id"].eqNullSafe(part["_id"]), "left").drop("_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", sha256(F.lit(""))).alias("repaired_sha256"),
    )
