"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# where staged tables go, if not straight into the shared folder
_PLACE: ContextVar[str | None] = ContextVar("place", default=None)

# Only runtime-settable options; cluster sizing stays with whoever submits the job.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partition even where that costs a shuffle later on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the options and ships this package's task functions along with their jobs, so
    that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules["tablesync"])
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in a local session, where the
    driver and its executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tablesync-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a result that several later steps read, and reads it back.

    A columnar table in the shared folder: it survives the loss of any executor, later
    steps read only the columns they need, and their plans start from it.
    """
    path = f"{_PLACE.get() or checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write
    if _PLACE.get():  # written once and read a few times, beside others of the same step
        out = out.option("compression", "zstd")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging_in(place: str | None) -> Iterator[None]:
    """Tables staged inside go into this folder."""
    token = _PLACE.set(place)
    try:
        yield
    finally:
        _PLACE.reset(token)


@contextmanager
def scratch(spark: SparkSession, name: str, on: bool = True) -> Iterator[str | None]:
    """Tables staged inside are removed at the end: what is to last is written elsewhere by then.

    Gives the place in use outside, for `staging_in`; with `on` false all stays as it is.
    """
    outside = _PLACE.get()
    if not on:
        yield outside
        return
    inside = f"{outside or checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        with staging_in(inside):
            yield outside
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inside)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(*sessions: SparkSession) -> Iterator[None]:
    """The shuffle files of a query leave the executors' disks when it ends, not when the driver
    next collects garbage. A frame that is run a second time shuffles again."""
    before = [(s, s.conf.get(_SHUFFLES, "false")) for s in sessions]
    for session in sessions:
        session.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        for session, value in reversed(before):
            session.conf.set(_SHUFFLES, value)


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stages independent results side by side, so small ones do not wait for large ones."""
    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        done = {name: pool.submit(copy_context().run, stage, df, name) for name, df in frames.items()}
        return {name: job.result() for name, job in done.items()}


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all the input there is and returns what it wrote."""
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
