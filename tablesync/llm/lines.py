"""Line dedup: lines whose key many documents hold are dropped everywhere.

The keys' hashes are range-partitioned with a secondary sort by document and position, each
partition is streamed once, and the answer is one small keep bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, WHITE, code_points, map_batches, pack, texts
from tablesync.session import stage

_LINES = "h1 long, h2 long, k1 long, k2 long, pos int"
_ORDER = ("h1", "h2", "k1", "k2", "pos")
# pos >= 0: a line to drop, for sure if h1 is null, else if the whole run of (h1, h2) counts
# enough documents. pos = -1: what one partition saw of a run at its border.
_FOUND = "k1 long, k2 long, pos int, h1 long, h2 long, docs int, part int, e1 long, e2 long"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _hash_lines(min_chars: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, positions, counts = [], [], []
        for data in texts(batch, "text"):
            before = len(positions)
            for pos, line in enumerate(data.split(b"\n")):
                key = line_key(line)
                if len(key) >= min_chars and code_points(key) >= min_chars:
                    digests.append(xxhash.xxh3_128_digest(key))
                    positions.append(pos)
            counts.append(len(positions) - before)
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        rows = np.repeat(np.arange(batch.num_rows), counts)
        keys = [pa.array(batch.column(k).to_numpy(zero_copy_only=False)[rows]) for k in KEY]
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *keys, pa.array(positions, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=list(_ORDER))

    return run


@dataclass
class _Run:
    """The rows of one hash in one partition, as far as they have been read."""

    key: tuple[int, int]
    first_of_partition: bool
    docs: int = 0
    start: tuple[int, int] = (0, 0)
    last: tuple[int, int] | None = None
    waiting: list[tuple[int, int, int]] = field(default_factory=list)


class _Stream:
    """Reads sorted lines; holds the lines of at most `min_docs` documents at a time."""

    def __init__(self, min_docs: int, part: int):
        self.min_docs, self.part = min_docs, part
        self.run: _Run | None = None
        self.out: list[tuple] = []

    def read(self, h1: int, h2: int, k1: int, k2: int, pos: int) -> None:
        run = self.run
        if run is None or run.key != (h1, h2):
            self.close(last=False)
            run = self.run = _Run((h1, h2), first_of_partition=run is None, start=(k1, k2))
        if run.last != (k1, k2):  # the first occurrence in one more document
            run.docs += 1
            run.last = (k1, k2)
        if run.docs < self.min_docs:
            run.waiting.append((k1, k2, pos))
            return
        for row in run.waiting:
            self.drop(*row)
        run.waiting = []
        self.drop(k1, k2, pos)

    def drop(self, k1: int, k2: int, pos: int, h1: int | None = None, h2: int | None = None) -> None:
        self.out.append((k1, k2, pos, h1, h2, None, None, None, None))

    def close(self, last: bool) -> None:
        """A run inside the partition is complete; one at its border may go on next door."""
        run = self.run
        if run is None or not (run.first_of_partition or last):
            return
        for row in run.waiting:
            self.drop(*row, *run.key)
        self.out.append((*run.start, -1, *run.key, run.docs, self.part, *run.last))

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 9
        self.out = []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs, TaskContext.get().partitionId())
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in _ORDER)):
                stream.read(*row)
            yield stream.flush()
        stream.close(last=True)
        yield stream.flush()

    return run


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(k1, k2, keep_bitmap) for each row of `docs` (doc_id, text) that loses lines.

    keep_bitmap is zlib-compressed, one bit per line up to the byte of the last dropped one,
    1 = keep; lines behind it stay. k1, k2 are the row's hashes; equal rows count as one document.

    The range partitioner cuts by (hash, document, position), so a line that a third of all
    documents hold spreads over many partitions. Inside a partition a run is decided as soon
    as it is complete or has counted enough documents; only the runs at both borders wait, with
    fewer than `min_docs` documents each, and are settled by two summary rows per partition.
    """
    rows = pack(docs, "doc_id", "text").select(*KEY, "text")
    hashed = stage(map_batches(rows, _hash_lines(min_chars), _LINES), "lines")
    found = stage(
        hashed.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_stream(min_docs), _FOUND),
        "line-runs",
    )
    pieces = found.filter("pos < 0")
    by_hash = Window.partitionBy("h1", "h2").orderBy("part")
    shared = (F.lag("e1").over(by_hash) == F.col("k1")) & (F.lag("e2").over(by_hash) == F.col("k2"))
    frequent = (
        pieces.withColumn("own", F.col("docs") - F.coalesce(shared, F.lit(False)).cast("int"))
        .groupBy("h1", "h2")
        .agg(F.sum("own").alias("total"))
        .filter(F.col("total") >= min_docs)
        .select("h1", "h2")
    )
    lines = found.filter("pos >= 0")
    settled = lines.filter("h1 is null").select(*KEY, "pos")
    waiting = lines.filter("h1 is not null").join(frequent, ["h1", "h2"], "left_semi")
    dropped = (
        settled.unionByName(waiting.select(*KEY, "pos"))
        .groupBy(*KEY)
        .agg(F.collect_set("pos").alias("positions"))
    )
    return map_batches(dropped, _to_bitmaps, "k1 long, k2 long, keep_bitmap binary")


def _to_bitmaps(batch: pa.RecordBatch) -> pa.RecordBatch:
    maps = []
    for positions in batch.column("positions"):
        lost = np.asarray(positions.values)
        keep = np.ones((int(lost.max()) // 8 + 1) * 8, np.uint8)  # whole bytes
        keep[lost] = 0
        maps.append(zlib.compress(np.packbits(keep).tobytes()))
    return pa.RecordBatch.from_arrays(
        [batch.column("k1"), batch.column("k2"), pa.array(maps, pa.binary())],
        names=[*KEY, "keep_bitmap"],
    )


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
    return np.concatenate([bits, np.ones(n_lines - len(bits), np.uint8)]).astype(bool)


def _apply(text_at: int, columns: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, totals, drops = [], [], []
        bitmaps = batch.column("keep_bitmap").to_pylist()
        for data, bitmap in zip(texts(batch, f"c{text_at}"), bitmaps):
            lines = data.count(b"\n") + 1
            lost = 0
            if bitmap is not None:
                keep = read_bitmap(bitmap, lines)
                lost = lines - int(keep.sum())
                data = b"\n".join(line for line, stays in zip(data.split(b"\n"), keep) if stays)
            kept.append(data)
            totals.append(lines)
            drops.append(lost)
        out = list(batch.columns[:columns])
        fresh = pa.array(kept, pa.large_binary()).cast(pa.large_string())
        out[text_at] = fresh.cast(out[text_at].type)
        out += [pa.array(totals, pa.int64()), pa.array(drops, pa.int64())]
        return pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:columns], "n_lines", "n_dropped"])

    return run


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` (doc_id, text, any others) without the lines whose key at least `min_docs`
    documents hold, and two columns at the end: n_lines before dropping, and n_dropped.

    The key is the line without white space at its ends, A-Z lower-cased; keys of fewer than
    `min_chars` code points stay. Null text reads as one empty line and becomes empty text. A
    document may end with no line: it stays, with empty text. Equal rows count as one document
    and stay as many as they were. Empty table: no rows.
    """
    names = docs.columns
    bitmaps = keep_bitmaps(docs, min_docs, min_chars)
    packed = pack(docs, "doc_id", "text").select(*KEY, "_row").join(bitmaps, [*KEY], "left")
    flat = packed.select("_row.*", "keep_bitmap")
    kinds = [(f.name, f.dataType.simpleString()) for f in flat.schema.fields[:-1]]
    schema = ", ".join(f"{n} {k}" for n, k in [*kinds, ("n_lines", "long"), ("n_dropped", "long")])
    applied = map_batches(flat, _apply(names.index("text"), len(names)), schema)
    return applied.toDF(*names, "n_lines", "n_dropped")
