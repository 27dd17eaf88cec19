"""WARC archives: whole-file gzip streams are rewritten record by record, each as a gzip member
of its own, with an offset index beside the archive."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, pack, texts
from tablesync.session import checkpoint_root, stage

_CHUNK = 1 << 18
_LEVEL = 1
_GZIP = 31  # zlib's window bits for a gzip wrapper
# Fixed words of the format.
_VERSION, _END = b"WARC/1.1", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    def raw(self) -> bytes:
        lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in self.headers.items())]
        return b"\r\n".join(lines) + _END + self.block + _END


def sha1_base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def one_line(text: str) -> str:
    """A header value: control characters and percent signs are percent-coded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or c in "%\x7f" else c for c in text)


def record_of(page: dict) -> Record:
    """A response with its payload, or a revisit with the payload's HTTP head only."""
    data, number = page["html"], page["record"]
    kind = "revisit" if page["refers_to"] is not None else "response"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode()
    block = head + (data if kind == "response" else b"")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{number}>",
        "WARC-Target-URI": one_line(page["url"] or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1_base32(page['digest'])}",
        "X-Page-Id": json.dumps(page["page_id"]),
    }
    if kind == "revisit":
        headers |= {
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": f"<urn:page:{page['refers_to']}>",
            "X-Refers-To-Page-Id": json.dumps(page["refers_to_page"]),
        }
    return Record(headers | {"Content-Length": str(len(block))}, block)


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whether of one member or of many, a bounded piece at a time."""
    machine = zlib.decompressobj(_GZIP)
    for chunk in chunks:
        while chunk:
            yield machine.decompress(chunk, _CHUNK)
            chunk = machine.unconsumed_tail
            if machine.eof:
                chunk = machine.unused_data
                machine = zlib.decompressobj(_GZIP)
    yield machine.flush()


def read_records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records from a stream of bytes; one record is held at a time."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while (end := held.find(_END)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's headers")
                return
        version, *lines = bytes(held[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts with {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + len(_END)
        stop = start + int(headers["Content-Length"])
        while len(held) < stop + len(_END):
            if not more():
                raise ValueError("the archive ends inside a record's block")
        yield Record(headers, bytes(held[start:stop]))
        del held[: stop + len(_END)]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder's file system, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _chunks(file) -> Iterator[bytes]:
    while chunk := file.read(_CHUNK):
        yield chunk


def _write_whole(root: str):
    """One archive per task, a single gzip stream, under a name of this attempt alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        path, packer, file, records = None, None, None, 0
        for batch in batches:
            columns = [n for n in batch.schema.names if n != "html"]
            rows = batch.select(columns).to_pylist()
            for row, html in zip(rows, texts(batch, "html")):
                if file is None:
                    path = f"{folder}/whole-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    file = store.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                file.write(packer.compress(record_of(row | {"html": html}).raw()))
                records += 1
        if file is not None:
            file.write(packer.flush())
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})

    return run


def _normalise(root: str):
    """Reads each archive once and writes it again, one member per record; the sidecar has a line
    per record with where its member starts and how long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                target = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
                offset = seen = 0
                with (
                    store.open_input_stream(path, compression=None) as source,
                    store.open_output_stream(f"{target}.member.warc.gz", compression=None) as archive,
                    store.open_output_stream(f"{target}.cdxj", compression=None) as index,
                ):
                    for record in read_records(inflate(_chunks(source))):
                        packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                        member = packer.compress(record.raw()) + packer.flush()
                        archive.write(member)
                        line = {"id": record.headers["WARC-Record-ID"], "offset": offset, "length": len(member)}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        seen += 1
                if seen != records:
                    raise ValueError(f"{path} holds {seen} records of {records}")
                yield pa.RecordBatch.from_pydict(
                    {"archive": [f"{target}.member.warc.gz"], "index": [f"{target}.cdxj"], "records": [seen]}
                )

    return run


def read_member(file, offset: int, length: int) -> Record:
    """One record by its place in the index."""
    file.seek(offset)
    return next(read_records(inflate(iter([file.read(length)]))))


def _read_back(root: str):
    """Every record through the index; a response is held against its digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                with store.open_input_file(archive) as file, store.open_input_stream(index, compression=None) as lines:
                    yield from _rows(file, _lines(lines))

    return run


def _lines(file) -> Iterator[dict]:
    held = b""
    for chunk in _chunks(file):
        *whole, held = (held + chunk).split(b"\n")
        yield from map(json.loads, whole)


_READ = [
    "record", "page_id", "url", "record_type", "refers_to", "refers_to_page",
    "payload_bytes", "payload_digest", "payload",
]
_KINDS = [*map(pa.type_for_alias, ("string", "int64", *["string"] * 3, "int64", "int64", "string", "binary"))]


def _rows(file, places: Iterator[dict], most: int = 200) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for place in places:
        record = read_member(file, place["offset"], place["length"])
        headers = record.headers
        head, _, payload = record.block.partition(_END)
        size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = headers["WARC-Payload-Digest"][5:]
        if headers["WARC-Type"] == "revisit":
            payload = None
        elif (size, digest) != (len(payload), sha1_base32(hashlib.sha1(payload).hexdigest())):
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        refers = headers.get("WARC-Refers-To")
        held.append((
            headers["WARC-Record-ID"][10:-1], json.loads(headers["X-Page-Id"]), headers["WARC-Target-URI"],
            headers["WARC-Type"], refers and refers[10:-1],
            json.loads(headers.get("X-Refers-To-Page-Id", "null")), size, digest, payload,
        ))
        if len(held) == most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_READ)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes one record per row of `pages` (page_id, url, html) and returns (archive, index,
    records): member-wise archives in the shared folder, each with its sidecar index.

    Of rows with equal payloads of at least `least_bytes`, the one with the largest page_id is the
    response; the others are revisits that refer to it and carry no payload. Rows that repeat
    the response's page_id with its payload are responses too. A row without page_id is never
    referred to unless no equal row has one. Null html is an empty payload, null url an empty
    target. Empty table: no archives.

    Equal payloads are found by an aggregate over SHA-1, a second hash and length, so a payload of
    a third of all pages costs one row per task; the written result is joined back with the
    pages, where adaptive execution splits a hot key. A task that is run again writes files
    of its own, and only those that the finished tasks report are read.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, path = _store(folder)
    store.create_dir(path)
    text = F.coalesce("html", F.lit("")).cast("binary")
    rows = pack(pages, "page_id", "url", "html").select(
        "page_id", "url", "html", *KEY, F.sha1(text).alias("digest"), F.xxhash64(text).alias("second"),
        F.octet_length(text).cast("long").alias("size"),
    )
    same = ["digest", "second", "size"]
    number = F.concat_ws("-", F.lower(F.hex("k1")), F.lower(F.hex("k2"))).alias("record")
    best = stage(
        rows.filter(F.col("size") >= least_bytes)
        .groupBy(*same)
        .agg(F.max(F.struct("page_id", "k1", "k2")).alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(*same, F.col("best.page_id").alias("best_id"), F.concat_ws("-", F.lower(F.hex("best.k1")), F.lower(F.hex("best.k2"))).alias("best_record")),
        "warc-best",
    )
    decided = rows.join(best, same, "left").select(
        "page_id", "url", number, "digest", "size",
        F.when(~F.col("page_id").eqNullSafe(F.col("best_id")), F.col("best_record")).alias("refers_to"),
        F.col("best_id").alias("refers_to_page"), "html",
    )
    decided = decided.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    whole = stage(decided.mapInArrow(_write_whole(folder), "path string, records long"), "warc-whole")
    spread = whole.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return stage(spread.mapInArrow(_normalise(folder), "archive string, index string, records long"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: record (its name), page_id, url, record_type, refers_to and
    refers_to_page (the record it refers to and its page_id, null in a response), payload_bytes, payload_digest (bare base32 SHA-1) and payload (null in a revisit)."""
    root = checkpoint_root(archives.sparkSession)
    schema = (
        "record string, page_id long, url string, record_type string, refers_to string,"
        " refers_to_page long, payload_bytes long, payload_digest string, payload binary"
    )
    spread = archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "archive")
    return spread.mapInArrow(_read_back(root), schema)
