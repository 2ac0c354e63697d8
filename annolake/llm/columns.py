"""Columns of texts or binary values as numpy arrays of their bytes, and back."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: Python workers live on from stage to stage, and what one stage has touched the next would lack."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binary values without nulls, and where they end, from 0."""
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def joined(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The reverse of `parts`; values that together pass the 2 GB of a plain column get wide offsets."""
    kind, size = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(size)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batches: Iterator[pa.RecordBatch], column: str | int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of a column, one row at least."""
    for batch in batches:
        _, ends = parts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
