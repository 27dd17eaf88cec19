"""Helpers that several operators share: tables, row keys, packed rows, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.session import configure

# The only characters that separate words: space, tab, line feed, VT, FF, carriage return.
WHITE = b" \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

KEY = ("k1", "k2")
_ROWS_PER_BATCH = "500"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and small Arrow batches: texts can be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _ROWS_PER_BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _hashable(field: T.StructField, column: Column) -> Column:
    """Maps have no hash of their own; their JSON form has."""
    return F.to_json(column) if "map<" in field.dataType.simpleString() else column


def pack(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, two hashes of the whole row (128 bits together) and the row itself
    as the struct `_row`. Whatever other columns a table has, and however they are called,
    they meet no name used inside an operator. Equal rows have equal hashes."""
    names = df.columns
    missing = [n for n in needed if n not in names]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    hashed = [_hashable(f, flat[f.name]) for f in flat.schema.fields]
    return flat.select(
        *[flat[f"c{names.index(n)}"].alias(n) for n in needed],
        F.xxhash64(*hashed).alias("k1"),
        F.xxhash64(F.lit(1), *hashed).alias("k2"),
        F.struct(*flat.columns).alias("_row"),
    )


def id_type(docs: DataFrame) -> str:
    """The type of doc_id, as a schema string has it."""
    return docs.schema["doc_id"].dataType.simpleString()


def unpack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("_row.*").toDF(*names)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType
) -> DataFrame:
    """fn over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a batch as UTF-8, one at a time; null reads as empty."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py() or b""


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUATION))


_CONTINUATION = bytes(range(0x80, 0xC0))
