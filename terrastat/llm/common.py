"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from terrastat.session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage is cut, and a lost executor costs only a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SLICE_BYTES = 2 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
# Spark's own values of the two settings, replaced by those above.
DEFAULT_ROWS, DEFAULT_BYTES = "10000", "67108864b"

# What a worker process holds beyond a batch: one operator's tables at a time.
_HELD: dict = {}


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Slices of an Arrow batch whose ``column`` (text or binary) holds about
    ``limit`` bytes each, and one row at least: what a task turns into Python
    objects at once is bounded by bytes, not by rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def held(key, make: Callable):
    """An operator's table, made once a worker process; another key of the same
    operator takes its place."""
    if _HELD.get("key") != key:
        _HELD.pop("table", None)
        _HELD.update(key=key, table=make())
    return _HELD["table"]


def enter(owner: str) -> None:
    """Called where a task begins: tables of another operator, left in a worker
    that Spark uses again, go first."""
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner


def give_back() -> None:
    """Return free memory of Arrow and the C library to the system: a worker
    that waits for its next task should not keep what a task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries
        pass


def small_batches(spark: SparkSession) -> None:
    """Short Arrow batches, unless the session asks for others."""
    for name, default, value in (("maxRecordsPerBatch", DEFAULT_ROWS, BATCH_ROWS),
                                 ("maxBytesPerBatch", DEFAULT_BYTES, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))


def mapped(rows: DataFrame, run: Callable[[Iterator], Iterator], schema, owner: str) -> DataFrame:
    """``rows.mapInArrow`` with bounded memory in the workers: short batches, one
    operator's tables at a time, and free memory given back after each task."""
    small_batches(rows.sparkSession)

    def task(batches):
        enter(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(task, schema)
