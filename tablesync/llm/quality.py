"""Quality rules: lines that many documents of a host share are removed, and a document that
is left with too little goes. `judge` gives the figures, `keep_good` the cleaned documents."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import KEY, WHITE, code_points, id_type, map_batches, pack, texts
from tablesync.session import stage

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SEED_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate of its host if more than `max_docs` of the host's documents hold it,
    however many the host has. A document is depleted if boilerplate was removed and fewer
    than `min_words` words or less than `min_left` of its words are left."""

    max_docs: int = 20
    min_words: int = 20
    min_left: float = 0.30


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words (a power of two) that occur twice or more.

    Windows get exact numbers by doubling: equal pairs of numbered halves share a number.
    """
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < width:
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        found, ids = np.unique(pairs, return_inverse=True)
        if len(found) == len(ids):
            return 0
        span *= 2
    hit = (np.bincount(ids)[ids] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(hit)] += hit
    edges[width : width + len(hit)] -= hit
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _line_key(parts: list[bytes]) -> bytes:
    return b" ".join(parts).lower()


def _line_hash(key: bytes, host: int) -> int:
    return xxhash.xxh3_64_intdigest(key, host & _SEED_MASK)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    figures: list[tuple[int, ...]] = []
    hashes, sizes, ends = [], [], [0]
    for data, host in zip(texts(batch, "text"), batch.column("host").to_pylist()):
        words = data.split()
        white = len(data) - len(data.translate(None, WHITE))
        seen: set[bytes] = set()
        weight: Counter[bytes] = Counter()
        again = 0
        for line in data.split(b"\n"):
            parts = line.split()
            if parts:
                again += line in seen
                seen.add(line)
                weight[_line_key(parts)] += len(parts)
        symbols = len(data) - len(data.translate(None, _SYMBOLS))
        figures.append((len(words), code_points(data) - white, symbols, again, repeated_words(words)))
        hashes += [_line_hash(k, host) for k in weight]
        sizes += weight.values()
        ends.append(len(hashes))
    lines = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())],
            ["line", "words"],
        ),
    )
    columns = [pa.array(c, pa.int64()) for c in zip(*figures)]
    kept = [batch.column(n) for n in ("doc_id", *KEY, "host", "content")]
    return pa.RecordBatch.from_arrays([*kept, *columns, lines], names=_NAMES)


_NAMES = [
    "doc_id", *KEY, "host", "content",
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines",
]


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): its figures, `base_failed` and `kept`,
    with the row's hashes k1 and k2. The texts without boilerplate come from `keep_good`.

    Each text is read once; its figures and the hashes of its lines (64 bits, seeded with the
    host) are written, and all else works on those. Documents of a host are counted per line
    as distinct texts, so copies of one text do not make its lines boilerplate. The count is
    an aggregate with map-side combining: a line that a third of all documents hold costs one
    row per task. Lines above the limits are a small table, joined to the lines by a broadcast
    only if its written size is under the session's threshold.

    Null text: no words, base_failed. Null source: a host of its own. Equal rows count as one
    document and get equal results. Empty table: no rows.
    """
    return _judged(docs, limits).drop("removed_lines")


def _judged(docs: DataFrame, limits: Limits) -> DataFrame:
    """`judge` and the hashes of each row's boilerplate lines (removed_lines, null if it has none)."""
    packed = pack(docs, "doc_id", "source", "text").select(
        "doc_id", *KEY, "text",
        F.xxhash64("source").alias("host"), F.xxhash64("text").alias("content"),
    )
    measured = stage(
        map_batches(
            packed,
            _measure,
            f"doc_id {id_type(docs)}, k1 long, k2 long, host long, content long, n_words long, word_chars long,"
            " n_symbols long, n_dup_lines long, n_repeat_words long,"
            " lines array<struct<line: long, words: long>>",
        ),
        "quality",
    )
    lines = measured.select(*KEY, "host", "content", F.explode("lines").alias("l")).select(
        *KEY, "host", "content", "l.line", "l.words"
    )
    common = stage(
        lines.groupBy("line", "host")
        .agg(F.count_distinct("content").alias("held"))
        .filter(F.col("held") > limits.max_docs)
        .select("line", "host"),
        "quality-lines",
    )
    removed = (
        lines.select(*KEY, "host", "line", "words")
        .join(common, ["line", "host"])
        .dropDuplicates([*KEY, "line"])
        .groupBy(*KEY)
        .agg(F.sum("words").alias("removed"), F.collect_list("line").alias("removed_lines"))
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed")
    depleted = F.coalesce(
        (F.col("removed") > 0)
        & ((left < limits.min_words) | (left < limits.min_left * F.col("n_words"))),
        F.lit(False),
    )
    return (
        measured.drop("lines", "host", "content")
        .join(removed, [*KEY], "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~depleted)
        .drop("removed")
    )


def _without_lines(text_at: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(f"c{text_at}")
        hosts, lost = (batch.column(n).to_pylist() for n in ("host", "removed_lines"))
        kept: list[bytes | None] = []
        for data, whole, host, gone in zip(texts(batch, f"c{text_at}"), batch.column(at).is_valid(), hosts, lost):
            if gone:
                held = {h & _SEED_MASK for h in gone}
                lines = ((line, line.split()) for line in data.split(b"\n"))
                data = b"\n".join(x for x, parts in lines if not parts or _line_hash(_line_key(parts), host) not in held)
            kept.append(data if whole.as_py() else None)
        out = list(batch.columns[:-2])
        out[at] = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(out[at].type)
        return pa.RecordBatch.from_arrays(out, names=batch.schema.names[:-2])

    return run


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` whose verdict is kept, with all their columns; their texts are without
    the lines that are boilerplate of their host. All other lines stay as they are, blank ones
    too. Equal rows stay as many as they were."""
    names = docs.columns
    verdicts = _judged(docs, limits).filter("kept").groupBy(*KEY).agg(F.any_value("removed_lines").alias("removed_lines"))
    packed = pack(docs, "doc_id", "source", "text").select(*KEY, "_row", F.xxhash64("source").alias("host"))
    flat = packed.join(verdicts, [*KEY]).select("_row.*", "host", "removed_lines")
    cleaned = map_batches(flat, _without_lines(names.index("text")), T.StructType(flat.schema.fields[:-2]))
    return cleaned.toDF(*names)
