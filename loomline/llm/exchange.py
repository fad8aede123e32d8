"""A shuffle of packed arrays: a map task sorts its entries by bucket and sends one row a bucket, with the entries as binary columns. Ten
million entries are then some thousand rows, and the reducing task reads them with numpy. Buckets are as many as the data needs, so that
one holds about ENTRIES entries whatever the size of the input; callers drop repeats within a flush first, so a hot key adds to a bucket at
most one entry a flush.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = 500_000


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def buckets_for(entries: float) -> int:
    return max(16, int(np.ceil(entries / ENTRIES)))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of a mixed 64-bit key."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array of the runs of values between cuts."""
    values = np.ascontiguousarray(values)
    off = (cuts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(off), pa.py_buffer(values)])


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column.to_pylist() if x] or [np.zeros(0, dtype)])


def lengths(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.array([len(x or b"") // np.dtype(dtype).itemsize for x in column.to_pylist()], np.int64)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(buckets that occur, cuts, columns in bucket order)."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return b[first], np.r_[first, len(b)].astype(np.int64), [c[order] for c in columns]
