"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word shingles have similarity PERCENT / 100 or more. A set of n shingles shares at least
T = ceil(n PERCENT / 100) of them with any partner: the partner occurs in T of the n inverted lists of the set's shingles. Two things follow,
and both are used exactly.

1. Sets are taken once over the texts; equal sets form one class, and one row of each class goes on, so copies are never paired.
2. A document of which fewer than T shingles occur anywhere else has no partner. Shingles are dealt packed to buckets that count their
   documents, and each document hears how many of its own are shared. Only documents with T or more go on (in the corpora at hand a tenth).
3. Among those the exact document frequency of every shingle is counted. Partners meet in one of the n - T + 1 rarest, so documents that meet in
   such a list (and whose sizes allow a link, from one to the next) are joined to families; no link crosses two families.
4. The sets of a family come together in a task, which holds their inverted lists, and each document is searched for by DivideSkip: its
   short lists are merged with a heap, skipping what cannot occur often enough, its long lists are probed by binary search, and only
   documents that reach the required overlap leave the task, as edges that join two components. A few central documents are counted
   against all others first, so a large group of near copies is one component before the search, which then only asks for the rest.
5. A family of more than MOST shingles is dealt to blocks, each with the family's central documents. What is not in the family's main
   component afterwards is searched for in every block, in chunks; so work grows with the family times what is apart in it, not with its square.
6. Components by min-label propagation with pointer jumping; classes give their component to their documents.

Tables that grow with the corpus are joined by sort and merge, never broadcast, and rounds are stored: some thirty broadcasts of what is just
under Spark's threshold come together on the driver, and so do estimates of checkpointed rounds, which double in digits with every round.

Defined results: A-Z lower-cased; null text or text without words has an empty set, links with nothing and is its own component; with fewer
words than SIZE the whole sequence is the one shingle; equal texts are linked; rows with equal ids are rows of their own, with a line each;
a null id is never the smallest while there is another; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.common import bounded_batches, discarded, release, releasing, row_key, skew_join, stored
from loomline.llm.exchange import binary, bucket_of, buckets_for, by_bucket, unpack
from loomline.llm.textkit import grams, mix, row_of, slices, words

SIZE, PERCENT = 5, 75
#: Shingles and rows that are sent together.
FLUSH, FLUSH_ROWS = 1 << 19, 1 << 16
#: Shingles of a family that one task takes.
MOST = 1 << 20
#: Central documents of a family that is dealt to blocks, and of a block.
CENTRAL, PIVOTS = 4, 8
#: The weight in DivideSkip's choice of how many lists count as long.
MU = 0.0085


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, last row + 1, all shingles, bounds): each row's distinct shingles, sorted."""
    for batch in batches:
        for lo, hi, data, off in slices(batch["text"]):
            h, bounds = words(data, off, lower=True)
            g, at = grams(h, bounds, size)
            row = np.searchsorted(bounds, at, "right") - 1
            n = np.diff(bounds)
            short = np.flatnonzero((n > 0) & (n < size))
            if len(short):
                whole = np.array([int.from_bytes(xxhash.xxh3_64_digest(h[bounds[r] : bounds[r + 1]].tobytes()), "big") for r in short], np.uint64)
                g, row = np.concatenate([g, whole]), np.concatenate([row, short])
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            keep = np.ones(len(g), bool)
            keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, row = g[keep], row[keep]
            yield batch, lo, hi, g, np.searchsorted(row, np.arange(hi - lo + 1))


def at_least(n, percent: int):
    """T: the shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def overlap(n, m, percent: int):
    """The shingles that sets of n and m must share to link."""
    return -(-(n + m) * percent // (100 + percent))


def classes_of(g: np.ndarray, bounds: np.ndarray) -> list:
    """A hash of each row's set; null if it is empty."""
    raw = g.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) >> 1 if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def describe(keyed: DataFrame, size: int) -> DataFrame:
    """(k, i, text) -> (k, i, n, c): set size and class."""

    def run(batches):
        for batch, lo, hi, g, bounds in shingle_sets(batches, size):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part["k"], part["i"], pa.array(np.diff(bounds), pa.int64()), pa.array(classes_of(g, bounds), pa.int64())], ["k", "i", "n", "c"])

    return keyed.mapInArrow(releasing(run), f"k long, i {keyed.schema['i'].dataType.simpleString()}, n long, c long")


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte by byte, all first bytes first."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def _unpack(packed: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


SENT = "bucket int, flush long, tokens binary, rows binary, ks binary, ns binary, cs binary"


class _Flush:
    """Shingles of some rows, to be dealt to buckets: of each bucket the lower halves of their mixed hashes, sorted, and the rows they are of.
    Two shingles that agree in bucket and lower half count as one, which can only keep more documents or order them otherwise."""

    def __init__(self, buckets: int):
        self.buckets, self.part, self.number = buckets, TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.g, self.n, self.k, self.c, self.held, self.seen = [], [], [], [], 0, set()

    def add(self, k: int, c: int, g: np.ndarray) -> bool:
        """Take a set, once for each class; whether it is time to send."""
        if c not in self.seen:
            self.seen.add(c)
            self.g.append(g)
            self.n.append(len(g))
            self.k.append(k)
            self.c.append(c)
            self.held += len(g)
        return self.held >= FLUSH or len(self.k) >= FLUSH_ROWS

    def send(self) -> pa.RecordBatch:
        self.number += 1
        flush = self.part << 32 | self.number
        h = mix(np.concatenate(self.g))
        row = np.repeat(np.arange(len(self.n), dtype=np.uint16), self.n)
        at = bucket_of(h, self.buckets)
        low = h.astype(np.uint32)
        order = np.argsort(at.astype(np.uint64) << np.uint64(32) | low)
        at, low, row = at[order], low[order], row[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        tokens = [_pack(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in spans]
        rows = [_pack(row[a:b]) for a, b in spans]
        own = bucket_of(mix(np.array([flush], np.uint64)), self.buckets)
        head = [np.array(x, t).tobytes() for x, t in ((self.k, np.int64), (self.n, np.int32), (self.c, np.int64))]
        none = [None] * len(spans)
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at[cuts[:-1]], own].astype(np.int32)), pa.array(np.full(len(spans) + 1, flush, np.int64)), *(pa.array(x, pa.binary()) for x in ([*tokens, None], [*rows, None], *([*none, x] for x in head)))],
            ["bucket", "flush", "tokens", "rows", "ks", "ns", "cs"],
        )


def _met(group: pa.Table) -> tuple[list[dict], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: headers, which pass through; of the other lines the flushes, and of their shingles the line, the row and the document count."""
    lines = group.to_pylist()
    heads = [x for x in lines if x["ks"] is not None]
    lines = [x for x in lines if x["ks"] is None]
    low = [np.cumsum(_unpack(x["tokens"], np.uint32), dtype=np.uint32) for x in lines]
    row = np.concatenate([_unpack(x["rows"], np.uint16) for x in lines] or [np.zeros(0, np.uint16)])
    line = np.repeat(np.arange(len(low)), [len(x) for x in low])
    low = np.concatenate(low or [np.zeros(0, np.uint32)])
    _, at, count = np.unique(low, return_inverse=True, return_counts=True)
    return heads, lines, low, line, row, (count[at] if len(low) else np.zeros(0, np.int64))


def shared(keyed: DataFrame, described: DataFrame, size: int, percent: int) -> DataFrame:
    """(k, c, n) of the documents of which T or more shingles occur in another document too."""
    buckets = buckets_for(described.agg(F.sum("n")).first()[0] or 0)

    def deal(batches):
        out = _Flush(buckets)
        for batch, lo, hi, g, bounds in shingle_sets(batches, size):
            for k, c, a, b in zip(batch["k"][lo:hi].to_pylist(), classes_of(g, bounds), bounds[:-1].tolist(), bounds[1:].tolist()):
                if c is not None and out.add(k, c, g[a:b]):
                    yield out.send()
        if out.g:
            yield out.send()

    def count(group: pa.Table) -> pa.Table:
        heads, lines, _, line, row, df = _met(group)
        many = df > 1
        pairs, times = np.unique(line[many] << 16 | row[many], return_counts=True)
        cuts = np.searchsorted(pairs >> 16, np.arange(len(lines) + 1))
        out = [(x["flush"], None, None, x["ks"], x["ns"], x["cs"]) for x in heads]
        for x, a, b in zip(lines, cuts[:-1], cuts[1:]):
            if b > a:
                out.append((x["flush"], _pack((pairs[a:b] & 0xFFFF).astype(np.uint16)), _pack(times[a:b].astype(np.uint32)), None, None, None))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        release()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["flush", "rows", "times", "ks", "ns", "cs"])

    def gather(group: pa.Table) -> pa.Table:
        lines = group.to_pylist()
        head = next(x for x in lines if x["ks"] is not None)
        k, n, c = np.frombuffer(head["ks"], np.int64), np.frombuffer(head["ns"], np.int32).astype(np.int64), np.frombuffer(head["cs"], np.int64)
        m = np.zeros(len(k), np.int64)
        for x in lines:
            if x["rows"] is not None:
                m[_unpack(x["rows"], np.uint16)] += _unpack(x["times"], np.uint32)
        ok = m >= at_least(n, percent)
        return pa.table({"k": k[ok], "c": c[ok], "n": n[ok]})

    sent = keyed.select("k", "text").mapInArrow(releasing(deal), SENT)
    counted = sent.groupBy("bucket").applyInArrow(count, "flush long, rows binary, times binary, ks binary, ns binary, cs binary")
    return counted.groupBy("flush").applyInArrow(gather, "k long, c long, n long")


def sets_of(keyed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(c, n, items) of the wanted rows (k, c, n): sorted shingles, from the texts once more."""
    maybe = keyed.sparkSession.sparkContext.broadcast(bloom.build(wanted.select("k"), wanted.count()))

    def sets(batches):
        # the filter is probed here and not in a UDF of its own, so a stage runs one Python operator and one worker a core
        some = (b.filter(pa.array(bloom.has(maybe.value, b["k"].to_numpy()))) for b in batches)
        for batch, lo, hi, g, bounds in shingle_sets(some, size):
            yield pa.RecordBatch.from_arrays([batch["k"].slice(lo, hi - lo), pa.array(classes_of(g, bounds), pa.int64()), binary(g, bounds)], ["k", "c", "items"])

    return keyed.select("k", "text").mapInArrow(releasing(sets), "k long, c long, items binary").join(wanted.hint("merge"), ["k", "c"]).dropDuplicates(["c"]).select("c", "n", "items")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(c, n, tokens): of each set the shared ones among its n - T + 1 rarest shingles, in this order, each as bucket << 32 | lower half."""
    buckets = buckets_for(sets.agg(F.sum("n")).first()[0] or 0)

    def deal(batches):
        out = _Flush(buckets)
        for batch in batches:
            for c, items in zip(batch["c"].to_pylist(), batch["items"]):
                if out.add(c, c, np.frombuffer(items.as_buffer(), np.uint64)):
                    yield out.send()
        if out.g:
            yield out.send()

    def count(group: pa.Table) -> pa.Table:
        heads, lines, low, line, row, df = _met(group)
        many = df > 1
        low, line, row, df = low[many], line[many], row[many], np.minimum(df[many], 0xFFFFFFFF).astype(np.uint32)
        cuts = np.searchsorted(line, np.arange(len(lines) + 1))
        out = [(x["flush"], None, None, None, None, x["ns"], x["cs"]) for x in heads]
        for x, a, b in zip(lines, cuts[:-1], cuts[1:]):
            if b > a:
                out.append((x["flush"], x["bucket"], _pack(np.diff(low[a:b], prepend=np.uint32(0))), _pack(row[a:b]), _pack(df[a:b]), None, None))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        release()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["flush", "bucket", "tokens", "rows", "dfs", "ns", "cs"])

    def gather(group: pa.Table) -> pa.Table:
        lines = group.to_pylist()
        head = next(x for x in lines if x["cs"] is not None)
        n, c = np.frombuffer(head["ns"], np.int32).astype(np.int64), np.frombuffer(head["cs"], np.int64)
        lines = [x for x in lines if x["cs"] is None]
        empty = [np.zeros(0, np.int64)]
        token = np.concatenate([np.cumsum(_unpack(x["tokens"], np.uint32), dtype=np.uint32).astype(np.int64) | x["bucket"] << 32 for x in lines] or empty)
        row = np.concatenate([_unpack(x["rows"], np.uint16).astype(np.int64) for x in lines] or empty)
        df = np.concatenate([_unpack(x["dfs"], np.uint32).astype(np.int64) for x in lines] or empty)
        order = np.lexsort((token, df, row))
        token, row = token[order], row[order]
        m = np.bincount(row, minlength=len(c))
        first = np.r_[0, np.cumsum(m)]
        # shingles of this set alone come first and have no list
        left = np.maximum(m - at_least(n, percent) + 1, 0)
        keep = np.arange(len(row)) - first[row] < left[row]
        return pa.table({"c": c, "n": n, "tokens": binary(token[keep], np.r_[0, np.cumsum(left)])})

    sent = sets.select("c", "items").mapInArrow(releasing(deal), SENT)
    counted = sent.groupBy("bucket").applyInArrow(count, "flush long, bucket int, tokens binary, rows binary, dfs binary, ns binary, cs binary")
    return counted.groupBy("flush").applyInArrow(gather, "c long, n long, tokens binary").filter("octet_length(tokens) > 0")


class Forest:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def neighbours(ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b, lists): edges that join what meets in a short list, from the list's pivot a, the member in which the shingle comes first (of a
    group of near copies the one with the fewest shingles of its own). A list is cut where the next larger member is too large for a link."""
    buckets = buckets_for((ranked.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) / 8)

    def deal(batches):
        have, n = [], 0

        def packed():
            c, size, pos, t = (np.concatenate(x) for x in zip(*have))
            h = mix(t.view(np.uint64))
            at, cuts, cols = by_bucket(bucket_of(h, buckets), t, c, size, pos)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(binary(x, cuts) for x in cols)], ["bucket", "tokens", "cs", "ns", "places"])

        for batch in batches:
            for c, size, t in zip(batch["c"].to_pylist(), batch["n"].to_pylist(), batch["tokens"]):
                t = np.frombuffer(t.as_buffer(), np.int64)
                have.append((np.full(len(t), c, np.int64), np.full(len(t), size, np.int32), np.arange(len(t), dtype=np.int32), t))
                n += len(t)
                if n >= FLUSH:
                    yield packed()
                    have, n = [], 0
        if have:
            yield packed()

    def edges(group: pa.Table) -> pa.Table:
        t, c, n, pos = unpack(group["tokens"], np.int64), unpack(group["cs"], np.int64), unpack(group["ns"], np.int32).astype(np.int64), unpack(group["places"], np.int32)
        order = np.lexsort((c, n, t))
        t, c, n, pos = t[order], c[order], n[order], pos[order]
        run = np.cumsum(np.r_[True, (t[1:] != t[:-1]) | (n[:-1] * 100 < n[1:] * percent)]) if len(t) else np.zeros(0, np.int64)
        order = np.lexsort((c, pos, run))
        run, c = run[order], c[order]
        whose = c[np.searchsorted(run, run)]
        apart = whose != c
        a, b = whose[apart], c[apart]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[first], "b": b[first], "lists": np.diff(np.r_[first, len(a)])})

    rows = ranked.mapInArrow(releasing(deal), "bucket int, tokens binary, cs binary, ns binary, places binary")
    return rows.groupBy("bucket").applyInArrow(edges, "a long, b long, lists long").groupBy("a", "b").agg(F.sum("lists").alias("lists"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (c, root): the smallest class that each linked class can reach."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "c"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("c", "b").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near.hint("merge"), F.col("c") == F.col("a")).select("c", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("c").alias("root"), F.col("root").alias("further"))
        new = stored(step.join(jump.hint("merge"), "root", "left").select("c", "was", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        discarded(label)
        if not new.filter("was != root").take(1):
            discarded(both)
            return new.select("c", "root")
        label = new.select("c", "root")


def divide_skip(lists: list[list[int]], n: int, percent: int) -> Iterator[tuple[int, int, list[list[int]]]]:
    """A query of n shingles with its inverted lists -> (document, occurrences in the short lists, the long lists) of all documents that can
    reach T. The long lists are left to be probed; the short ones are merged with a heap, and where a document occurs too rarely the lists
    are moved on to the first document that can occur often enough."""
    need = at_least(n, percent)
    if len(lists) < need:
        return
    lists = sorted(lists, key=len)
    set_aside = min(need - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, probe = lists[: len(lists) - set_aside], lists[len(lists) - set_aside :]
    need -= set_aside
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapify(heap)
    while len(heap) >= need:
        doc = heap[0][0]
        out = []
        while heap and heap[0][0] == doc:
            out.append(heappop(heap))
        if len(out) >= need:
            yield doc, len(out), probe
            for _, k, at in out:
                if at + 1 < len(short[k]):
                    heappush(heap, (short[k][at + 1], k, at + 1))
            continue
        while heap and len(out) < need - 1:
            out.append(heappop(heap))
        if not heap:
            return
        top = heap[0][0]
        for _, k, at in out:
            at = bisect_left(short[k], top, at)
            if at < len(short[k]):
                heappush(heap, (short[k][at], k, at))


def search(items: list[np.ndarray], label: np.ndarray, asks: np.ndarray, held: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join the components (label) of documents which link, where one of the two asks and the other is held. If two documents in
    different components link, their components are joined by some edges."""
    n = np.array([len(x) for x in items])
    inside = np.flatnonzero(held)
    token = np.concatenate([items[d] for d in inside])
    doc = np.repeat(inside, n[inside])
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    token, cuts = token[cuts], np.r_[cuts, len(doc)]
    length = np.diff(cuts)
    forest, edges, alike = Forest(len(items)), [], {}
    for d, x in enumerate(label.tolist()):
        forest.join(alike.setdefault(x, d), d)

    def lists_of(d: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(token, items[d]), len(token) - 1)
        return at[(token[at] == items[d]) & (length[at] > int(held[d]))]  # a list of d alone has nobody else

    def link(x: int, y: int) -> bool:
        if forest.join(x, y):
            edges.append((x, y))
            return True
        return False

    # central documents are counted against all others
    central = np.full(len(items), -1.0)
    if len(inside) >= 2 * PIVOTS:
        central[doc] = 0
        np.add.at(central, doc, np.repeat(length - 1.0, length))
        central[~asks] = -1
    idle = 0
    for _ in range(PIVOTS):
        p = int(central.argmax())
        if central[p] <= 0 or idle > 1:
            break
        times = np.zeros(len(items), np.int64)
        for at in lists_of(p).tolist():
            times[doc[cuts[at] : cuts[at + 1]]] += 1
        near = np.flatnonzero(held & (times >= overlap(n[p], n, percent)))
        new = sum(link(p, d) for d in near.tolist())
        idle = 0 if new > 1 else idle + 1
        central[p] = -1
        central[near] = -1
    queries = asks
    if (asks & held).all():  # of two documents apart, one at least is not in the main component
        roots = np.array([forest.root(d) for d in range(len(items))])
        queries = roots != np.bincount(roots).argmax()
    kept: dict[int, list[int]] = {}
    for q in np.flatnonzero(queries).tolist():
        own = lists_of(q).tolist()
        for at in own:
            if at not in kept:
                kept[at] = doc[cuts[at] : cuts[at + 1]].tolist()
        for d, times, probe in divide_skip([kept[at] for at in own], int(n[q]), percent):
            if forest.root(d) == forest.root(q):
                continue
            need, left = overlap(int(n[q]), int(n[d]), percent), len(probe)
            for x in reversed(probe):
                if times >= need or times + left < need:
                    break
                at = bisect_left(x, d)
                times += at < len(x) and x[at] == d
                left -= 1
            if times >= need:
                link(q, d)
    return edges


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """(g, family, c, label, asks, held, items) -> links (a, b); a family's rows with one g are searched together."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("family", "ascending"), ("c", "ascending")])
        family, c = group["family"].to_numpy(), group["c"].to_numpy()
        label, asks, held = (group[x].to_numpy() for x in ("label", "asks", "held"))
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["items"]]
        cuts = np.flatnonzero(np.r_[True, family[1:] != family[:-1], True])
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held[lo:hi].any():
                for x, y in search(items[lo:hi], label[lo:hi], asks[lo:hi], held[lo:hi], percent):
                    a.append(c[lo + x])
                    b.append(c[lo + y])
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("g").applyInArrow(run, "a long, b long")


def joined(sets: DataFrame, percent: int) -> DataFrame:
    """(c, root) of the classes that link with another."""
    stars = stored(neighbours(stored(prefixes(sets, percent), "prefixes"), percent), "stars")
    family = components(stars)
    member = stored(family.join(sets.select("c", "n").hint("merge"), "c").withColumnRenamed("root", "family"), "members")
    of = member.groupBy("family").agg(F.sum("n").alias("shingles"), F.count("*").alias("docs"))
    total, docs = of.agg(F.sum("shingles"), F.sum("docs")).first()
    parts = max(16, int((total or 0) * 2 // MOST))
    dealt = skew_join(member, of, "family", "docs", docs or 0, merge=True)
    blocks = F.ceil(F.col("shingles") * 2 / MOST)
    dealt = stored(dealt.withColumn("blocks", F.when(F.col("shingles") > MOST, blocks).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks"))), "dealt")
    both = {"asks": F.lit(True), "held": F.lit(True), "label": F.col("c")}
    g = F.when(F.col("blocks") > 1, F.xxhash64("family", "block")).otherwise(F.pmod(F.xxhash64("family"), F.lit(parts)))
    first = dealt.select("c", "family", "blocks", "block")
    large = dealt.filter("blocks > 1")
    if large.take(1):
        weight = stars.groupBy(F.col("a").alias("c")).agg(F.sum("lists").alias("lists"))
        chosen = large.join(weight.hint("merge"), "c").groupBy("family", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(CENTRAL))).agg(F.max_by("c", F.struct("lists", "c")).alias("c"), F.first("blocks").alias("blocks"))
        spread = chosen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("c", "family", "blocks", "block")
        first = first.unionByName(spread).distinct()
    links = stored(_searched(first.withColumns(both | {"g": g}).join(sets.select("c", "items").hint("merge"), "c"), percent), "links")
    found = components(links)
    if not large.take(1):
        return found
    # what is apart from the main component of a large family is searched for in each of its blocks
    placed = large.select("c", "n", "family", "blocks", "block").join(found.hint("merge"), "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root")
    main = placed.groupBy("family", "label").agg(F.count("*").alias("docs")).groupBy("family").agg(F.max_by("label", F.struct("docs", "label")).alias("main"), F.sum("docs").alias("docs"))
    placed = stored(skew_join(placed, main, "family", "docs", docs or 0, merge=True), "placed")
    apart = placed.filter("label != main")
    chunks = apart.groupBy("family").agg(F.ceil(F.sum("n") * 2 / MOST).alias("chunks"), F.count("*").alias("docs"))
    apart = skew_join(apart.drop("main"), chunks, "family", "docs", docs or 0, merge=True).withColumn("chunk", F.pmod(F.xxhash64("c", F.lit(2)), F.col("chunks")))
    until = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    ask = apart.withColumn("block", until(F.col("blocks"))).select("c", "family", "block", "chunk", "label", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    hold = skew_join(placed.drop("main"), placed.groupBy("family").agg(F.count("*").alias("docs")).join(chunks.select("family", "chunks").hint("merge"), "family"), "family", "docs", docs or 0, "inner", merge=True)
    hold = hold.filter("chunks is not null").withColumn("chunk", until(F.col("chunks"))).select("c", "family", "block", "chunk", "label", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    again = ask.unionByName(hold).withColumn("g", F.xxhash64("family", "block", "chunk")).drop("block", "chunk").join(sets.select("c", "items").hint("merge"), "c")
    more = stored(_searched(again, percent), "more")
    return components(links.unionByName(more)) if more.take(1) else found


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(k, i, n, c, root, component_id), a line for each row: its key, id, set size, class, the component's smallest class and smallest id."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text"))
    described = stored(describe(keyed, size), "described")
    found = stored(shared(keyed, described, size, percent), "shared")
    wanted = stored(found.groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n")), "wanted")
    comp = joined(stored(sets_of(keyed, wanted, size), "sets"), percent)
    classes = described.filter("c is not null").groupBy("c").agg(F.min("i").alias("low"), F.count("*").alias("rows"))
    rooted = stored(classes.join(comp.hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"))
    of, total = rooted.agg(F.count("*"), F.sum("rows")).first()
    final = stored(skew_join(rooted, smallest, "root", "classes", of, merge=True).select("c", "root", "component_id", "rows"), "components")
    full = skew_join(described.filter("c is not null"), final, "c", "rows", total or 0, merge=True)
    empty = described.filter("c is null").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("i")})
    return full.unionByName(empty)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id."""
    return grouped(docs, id_col, text_col, size, percent).select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Of each component one row of docs, with all its columns: one with the smallest id (null last), among those with the same id the one
    with the smallest key, and any one where id and text repeat. Rows without words stay, once where id and text repeat."""
    found = stored(grouped(docs, id_col, text_col, size, percent).select("k", "i", "root"), "grouped")
    best = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("i").isNull().alias("null"), "i", "k")).alias("best"))
    stay = best.select(F.col("best.k").alias("k")).unionByName(found.filter("root is null").select("k")).distinct()
    drop = found.select("k").distinct().join(stay.hint("merge"), "k", "left_anti")
    again = found.groupBy("k").count().filter("count > 1").select("k")
    touched = stored(drop.withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False))).groupBy("k").agg(F.max("gone").alias("gone")), "touched")
    keyed = docs.withColumn("__k", row_key(id_col, text_col))
    maybe = bloom.may_have(docs.sparkSession, bloom.build(touched.select("k"), touched.count()), F.col("__k"))
    probed = keyed.withColumn("__maybe", maybe)
    met = probed.filter("__maybe").join(touched.select(F.col("k").alias("__touched"), F.col("gone").alias("__gone")).hint("merge"), F.col("__k") == F.col("__touched"), "left")
    once = met.filter(F.col("__gone") == F.lit(False)).dropDuplicates(["__k"])
    free = met.filter(F.col("__gone").isNull())
    return probed.filter(~F.col("__maybe")).select(*docs.columns).unionByName(free.select(*docs.columns)).unionByName(once.select(*docs.columns))
