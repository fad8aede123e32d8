"""Bloom filters built on the executors and merged by chunk.

A filter takes BITS bits a key, rounded up to a power of two and at most MAX_BITS (32 MB), so what is broadcast has a fixed bound. Above it
more keys pass than need to; callers decide exactly on what passes, so results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.textkit import mix

BITS = 16
MAX_BITS = 1 << 28
HASHES = 3
CHUNK = 1 << 16
#: Tasks that build a filter: each holds one copy of it, so their number bounds what is shuffled.
BUILDERS = 32


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    one = mix(keys.astype(np.int64).view(np.uint64))
    two = mix(one ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            yield ((one + np.uint64(k) * two) & np.uint64(bits - 1)).astype(np.int64)


def has(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in places(keys, len(filter_bytes) * 8):
        found &= (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return found


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def build(keys: DataFrame, count: int, repeated: bool = False) -> np.ndarray:
    """The filter of a one-column frame of longs as bytes. repeated: only of keys that may have come before (two filters are kept while
    reading: a key already in the first goes into the second as well; merging adds what two tasks have both seen)."""
    col = keys.columns[0]
    bits = min(MAX_BITS, 1 << max(13, int(np.ceil(np.log2(max(1, count) * BITS)))))
    size = min(CHUNK, bits // 8)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = np.zeros(bits // 8, np.uint8)
        twice = np.zeros(bits // 8 if repeated else 0, np.uint8)
        for batch in batches:
            k = batch[col].dropna().to_numpy(np.int64)
            if repeated:
                k, n = np.unique(k, return_counts=True)
                again = (n > 1) | has(once, k)
                for at in places(k[again], bits):
                    _set(twice, at)
            for at in places(k, bits):
                _set(once, at)
        for lo in range(0, bits // 8, size):
            a, b = once[lo : lo + size], twice[lo : lo + size]
            if a.any():
                yield pd.DataFrame({"chunk": [lo // size], "once": [a.tobytes()], "twice": [b.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(size, np.uint8)
        twice = np.zeros(size, np.uint8)
        for a, b in zip(group["once"], group["twice"]):
            a = np.frombuffer(a, np.uint8)
            if repeated:
                twice |= np.frombuffer(b, np.uint8) | (once & a)
            once |= a
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "bits": [(twice if repeated else once).tobytes()]})

    parts = keys.coalesce(BUILDERS).mapInPandas(local, "chunk int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInPandas(merge, "chunk int, bits binary").toLocalIterator():
        out[row["chunk"] * size : row["chunk"] * size + size] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_have(spark, filter_bytes: np.ndarray, key: Column) -> Column:
    """Whether a long may be in the filter; null is not."""
    sent = spark.sparkContext.broadcast(filter_bytes)

    @F.pandas_udf("boolean")
    def probe(k: pd.Series) -> pd.Series:
        ok = k.notna().to_numpy()
        out = np.zeros(len(k), bool)
        out[ok] = has(sent.value, k[ok].to_numpy(np.int64))
        return pd.Series(out)

    return probe(key)
