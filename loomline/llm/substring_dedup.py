"""Substring dedup with difference-cover anchors.

A window of WINDOW words is removed when its word sequence starts anywhere else too. Anchors are runs of WINDOW - PERIOD + 1 words that start
at positions p of their document with p mod PERIOD in COVER. COVER is a difference cover: for any two starts i, j there is a shift d < PERIOD
with i + d and j + d both in it, so two equal windows share an aligned anchor. Only about |COVER| / PERIOD of all positions are hashed and
shuffled; anchors that repeat then extend: the windows that can hold them, and no others, are hashed whole and compared exactly by a
second exchange. No pairs are formed in either, so a passage that a third of all documents share costs as much as any other.

Defined results: words are unchanged; null or empty text has no words; texts under WINDOW words lose nothing; rows equal in id and text count
as two occurrences, and repeat each other; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.common import bounded_batches, row_key, stored
from loomline.llm.exchange import binary, bucket_of, buckets_for, by_bucket, text_bytes, unpack
from loomline.llm.textkit import grams, mix, slices, words

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Entries that a task gathers before it sends them.
FLUSH = 1 << 19
ROWS = "bucket int, kind int, hashes binary, keys binary, places binary"
FOUND = "k long, places binary"


def _packed(hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of one flush. Those whose hash occurs more than once in it are known repeats: their places go on as kind 1, dealt by key, and
    one marker (place -1) goes to the bucket of the hash for the other flushes."""
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    known = order[many]
    lone = order[~many]
    marks = h[first & many]
    hs = np.concatenate([hashes[lone], marks])
    ks = np.concatenate([keys[lone], np.zeros(len(marks), np.int64)])
    ps = np.concatenate([places[lone], np.full(len(marks), -1, np.int32)])
    for kind, (b, cols) in enumerate(((bucket_of(hs, buckets), (hs, ks, ps)), (bucket_of(mix(keys[known].view(np.uint64)), buckets), (np.zeros(0, np.uint64), keys[known], places[known])))):
        if not len(cols[1]):
            continue
        if kind:
            at, cuts, (k, p) = by_bucket(b, cols[1], cols[2])
            packed = pa.array([b""] * len(at), pa.binary())
        else:
            at, cuts, (hh, k, p) = by_bucket(b, *cols)
            packed = binary(hh, cuts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), kind, np.int32)), packed, binary(k, cuts), binary(p, cuts)], ["bucket", "kind", "hashes", "keys", "places"])


def _repeats(group: pa.Table, buckets: int) -> pa.Table:
    """Places of the hashes of a bucket that occur more than once, packed and dealt by document."""
    kind = group["kind"].to_numpy()
    sent, known = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
    h, k, p = unpack(sent["hashes"], np.uint64), unpack(sent["keys"], np.int64), unpack(sent["places"], np.int32)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    of = np.cumsum(first) - 1
    marked = np.zeros(int(first.sum()), bool)
    if len(h):
        marked[of[p[order] < 0]] = True
        marked |= np.bincount(of) > 1
    hit = order[marked[of] & (p[order] >= 0)] if len(h) else order
    k = np.concatenate([k[hit], unpack(known["keys"], np.int64)])
    p = np.concatenate([p[hit], unpack(known["places"], np.int32)])
    at, cuts, (k, p) = by_bucket(bucket_of(mix(k.view(np.uint64)), buckets), k, p)
    return pa.table({"part": pa.array(at, pa.int32()), "keys": binary(k, cuts), "places": binary(p, cuts)})


def _by_document(group: pa.Table) -> pa.Table:
    k, p = unpack(group["keys"], np.int64), unpack(group["places"], np.int32)
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return pa.table({"k": pa.array(k[first], pa.int64()), "places": binary(p, np.r_[first, len(k)].astype(np.int64))})


def _exchange(rows: DataFrame, buckets: int) -> DataFrame:
    """(k, places): of each document, the places found, as one binary. Both exchanges send packed entries, so their rows do not grow with the
    number of buckets that a document's places are spread over."""
    found = rows.groupBy("bucket").applyInArrow(lambda group: _repeats(group, 4 * buckets), "part int, keys binary, places binary")
    return found.groupBy("part").applyInArrow(_by_document, FOUND)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Each slice of rows with its word hashes and bounds."""
    for batch in batches:
        for lo, hi, data, off in slices(batch["text"]):
            yield batch, lo, hi, *words(data, off, lower=False)


def _flushed(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    have, n = [], 0
    for part in parts:
        have.append(part)
        n += len(part[0])
        if n >= FLUSH:
            yield from _packed(*(np.concatenate(x) for x in zip(*have)), buckets)
            have, n = [], 0
    if have:
        yield from _packed(*(np.concatenate(x) for x in zip(*have)), buckets)


def repeated_windows(keyed: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple = COVER) -> DataFrame:
    """keyed: (k, text) -> (k, places): int32 starts of the windows of each document whose words start anywhere else too."""
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period < window
    spark = keyed.sparkSession
    size = window - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True
    volume = text_bytes(keyed) / 6
    buckets = buckets_for(volume * len(cover) / period)

    def anchors(batches):
        def parts():
            for batch, lo, hi, h, bounds in _texts(batches):
                g, at = grams(h, bounds, size)
                row = np.searchsorted(bounds, at, "right") - 1
                place = (at - bounds[row]).astype(np.int32)
                ok = chosen[place % period] & (np.diff(bounds)[row] >= window)
                yield g[ok], batch["k"].to_numpy()[lo:hi][row[ok]], place[ok]

        yield from _flushed(parts(), buckets)

    found = stored(_exchange(keyed.mapInArrow(anchors, ROWS), buckets), "anchors")
    count = found.count()
    # a merge join: each stage then runs one Python operator, and so one worker a core
    held = keyed.filter(bloom.may_have(spark, bloom.build(found.select("k"), count), F.col("k"))).join(found.hint("merge"), "k")
    windows = buckets_for(volume / 3)

    def candidates(batches):
        def parts():
            for batch, lo, hi, h, bounds in _texts(batches):
                g, at = grams(h, bounds, window)
                near = np.zeros(len(h) + 1, np.int32)
                for row, places in zip(range(hi - lo), batch["places"][lo:hi].to_pylist()):
                    p = np.frombuffer(places, np.int32).astype(np.int64)
                    np.add.at(near, bounds[row] + np.maximum(p - period + 1, 0), 1)  # starts from p - period + 1 to p can hold the anchor
                    np.add.at(near, bounds[row] + p + 1, -1)
                ok = np.cumsum(near)[at] > 0
                row = np.searchsorted(bounds, at[ok], "right") - 1
                yield g[ok], batch["k"].to_numpy()[lo:hi][row], (at[ok] - bounds[row]).astype(np.int32)

        yield from _flushed(parts(), windows)

    return _exchange(held.select("k", "text", "places").mapInArrow(candidates, ROWS), windows)


def _covered(n: int, places: bytes, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    d = np.zeros(n + 1, np.int32)
    p = np.unique(np.frombuffer(places, np.int32))
    d[p] += 1
    d[p + window] -= 1
    return np.cumsum(d[:-1]) > 0


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """id_col, n_words, n_removed and the kept words joined by one space: kept_text, or with digest kept_sha256 of its UTF-8."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text"))
    cuts = stored(repeated_windows(keyed.select("k", "text"), window), "windows")
    maybe = bloom.build(cuts.select("k"), cuts.count())
    sent = spark.sparkContext.broadcast(maybe)
    name = "kept_sha256" if digest else "kept_text"

    def finish(batches):
        for batch in batches:
            text = batch["text"].to_pylist()
            places = batch["places"].to_pylist() if "places" in batch.schema.names else [None] * len(text)
            n, gone, kept = [], [], []
            for t, p in zip(text, places):
                w = t.encode().split()
                n.append(len(w))
                if p:
                    cut = _covered(len(w), p, window)
                    w = list(compress(w, ~cut))
                gone.append(n[-1] - len(w))
                out = b" ".join(w)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", name])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_removed long, {name} string"

    def untouched(batches):
        yield from finish(b.filter(pa.array(~bloom.has(sent.value, b["k"].to_numpy()))) for b in batches)

    clean = keyed.mapInArrow(untouched, schema)
    cut = keyed.filter(bloom.may_have(spark, maybe, F.col("k"))).join(cuts.hint("merge"), "k", "left").select("i", "text", "places").mapInArrow(finish, schema)
    return clean.unionByName(cut)
