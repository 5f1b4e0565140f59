"""Helpers for Arrow batches inside tasks: bounded slices of text rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Bytes of text handled at once in a task; more where repeated words within them save work.
CHUNK_BYTES, LARGE_CHUNK_BYTES = 2 << 20, 4 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), dtype=np.int64, count=n)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches.

    Spark reads the size of batches from the session when the whole plan runs, so the session's own setting is lowered
    and stays so; one that is lower already is left alone.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = conf.get(name).lower().removesuffix("b")
        size = int(now) if now.lstrip("-").isdigit() else int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]]
        if not 0 < size <= most:
            conf.set(name, str(most))


    def run(batches):
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give the memory that a task has freed back to the system: a worker stays for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts)
