"""Numpy arrays as bytes in columns, and sums of them over a table."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from oreworks.llm.common import stored


def release() -> None:
    """Give freed memory back to the system: a worker that is reused keeps it otherwise, next to what later stages need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc has it
        trim(0)


def pack(values: np.ndarray) -> bytes:
    """Byte planes compress far better than values do."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.compress(planes, 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def total(parts: DataFrame, length: int) -> np.ndarray:
    """Sum of the packed int64 arrays, each of `length` numbers, in the one column of `parts`.

    Sums form a tree over tasks. The driver gets a bounded number of bytes: at most 16 MB of numbers, or two arrays.
    """
    column = parts.columns[0]
    fan = max(2, (16 << 20) // (8 * length))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(length, np.int64)
        for batch in batches:
            for data in batch[column]:
                found += unpack(data, np.int64)
        yield pd.DataFrame({column: [pack(found)]})

    parts = stored(parts.where(f"`{column}` IS NOT NULL"))
    count = parts.count()
    while count > fan:
        count = -(-count // fan)
        parts = stored(parts.repartition(count).mapInPandas(add, f"`{column}` binary"))
    return sum((unpack(row[0], np.int64) for row in parts.collect()), np.zeros(length, np.int64))
