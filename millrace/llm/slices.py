"""Bounded slices of Arrow batches, and giving memory back when a task ends.

A batch holds up to 10,000 rows by default, whatever they weigh. Operators on texts ask for smaller batches and work on slices
of at most ``SLICE_BYTES`` of text (or one row), so what a worker holds besides its tables follows neither the length of
texts nor the batch size. Workers are reused between stages: a task's end returns freed memory to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES, BATCH_ROWS = 1 << 20, 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``; its session sends at most ``rows`` rows in an Arrow batch from now on (fewer, if it is set so)."""
    conf = df.sparkSession.conf
    now = int(conf.get(_SETTING, "10000"))
    if now <= 0 or now > rows:
        conf.set(_SETTING, str(rows))
    return df


def slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in ``column`` hold about ``limit`` bytes, one row at least; an empty batch gives nothing."""
    if isinstance(column, str):
        column = batch.schema.get_field_index(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back(cycles: bool = True) -> None:
    """Returns what is freed, but still held by allocators, to the system; without ``cycles``, Python's collector runs when it would anyway."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A task's generator that gives memory back at its end, however it ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table], cycles: bool = True) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that gives memory back after each (``cycles``: of arrays in reference cycles too, some 50 ms a group)."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back(cycles)

    return wrapped


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table], cycles: bool = True) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two groups that meet, which gives memory back after each pair."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back(cycles)

    return wrapped
