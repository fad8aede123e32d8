"""Approximate nearest neighbours by balanced posting lists, for the largest inner product.

Vectors get one more coordinate that makes all lengths equal, so the largest inner product is the smallest distance. Centroids come from
balanced clustering of a bounded sample, level by level; they are few enough to be held by every task together with a graph of their
neighbours, which is searched best-first from several entries. Every vector goes to its nearest list, and a boundary vector to further ones up to
REPLICAS: those whose centroids are within a ratio of the nearest that BOUNDARY of the sampled vectors have a second list in, CLOSURE at most.

A query searches the same graph for its nearest centroids and reads those lists whose distance is within a ratio of the nearest. The ratio and the
width of the search are learnt when the index is built: a bounded sample of queries has its true neighbours found by brute force, and both are
as large as it takes for RECALL of them (fitted). The nearest distance counts as half the sample's median at least, so a query that is itself a centroid
keeps its lists, and LEAST lists are read whatever their distance. So the share of lists read follows the data at any size. Lists longer than PART are cut into parts, and queries that meet in one list into blocks, so that a
task compares one block with one part and returns the best few of each query; a vector held by a third of all rows is only more parts.
The LEAST nearest lists of a query are compared first; from the others come only candidates whose score reaches its k-th best by then.

Scores are inner products of the vectors as given, in double precision, each summed in the same order, so equal vectors tie exactly and
smaller ids come first.

Defined results: vectors that are null, all zero or hold null or non-finite components take no part, nor do those whose length is not the most
common one (of equally common, the larger); rows with the query's id are not its candidates; a repeated query id is answered for each
different vector, and a row repeated with the same vector counts once; fewer candidates than asked for are all found; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.llm.common import stored

#: Vectors a list should hold, centroids at most, and vectors from which they are learnt at most (the bound of the sample).
LIST, MOST_CENTROIDS, MOST_SAMPLE = 100, 16_384, 131_072
REPLICAS, CLOSURE, BOUNDARY = 4, 1.15, 0.75
#: Lists that are searched for at least, and the recall that those within the ratio must reach over so many sampled queries.
LISTS = 16
#: So many are read whatever their distance.
LEAST = 8
RECALL, MOST_ASKED = 0.96, 512
PART, BLOCK = 2048, 1024
DEGREE, BEAM, ENTRIES = 24, 96, 16
FAN = 64


def _assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and all squared distances but for the row's own part, in blocks."""
    best = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for lo in range(0, len(x), 4096):
        best[lo : lo + 4096] = (half - x[lo : lo + 4096] @ c.T).argmin(1)
    return best, half


def balanced(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """k centroids of x; a penalty on the size of clusters evens them out."""
    k = min(k, len(x))
    if k <= 1:
        return x.mean(0, keepdims=True)
    if k > FAN:
        top = balanced(x, int(np.ceil(np.sqrt(k))), rng, rounds)
        of, _ = _assign(x, top)
        size = np.bincount(of, minlength=len(top))
        share = np.maximum(np.round(size * k / len(x)).astype(int), 1)
        return np.concatenate([balanced(x[of == j], int(share[j]), rng, rounds) for j in range(len(top)) if size[j]])
    c = x[rng.choice(len(x), k, replace=False)].copy()
    weight = np.zeros(k)
    for _ in range(rounds):
        half = (c * c).sum(1) / 2
        cost = half - x @ c.T
        of = (cost + weight).argmin(1)
        size = np.bincount(of, minlength=k)
        spread = float(np.abs(cost.min(1) + (x * x).sum(1) / 2).mean()) or 1.0
        weight += 0.1 * spread * (size * k / len(x) - 1)
        weight -= weight.min()
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


class Graph:
    """Centroids with links to their nearest neighbours and to some far ones."""

    def __init__(self, c: np.ndarray, rng: np.random.Generator):
        self.c = c.astype(np.float32)
        self.half = (self.c * self.c).sum(1) / 2
        k = len(c)
        near = min(DEGREE, max(k - 1, 1))
        links = np.empty((k, near), np.int64)
        for lo in range(0, k, 1024):
            d = self.half - self.c[lo : lo + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links[lo : lo + 1024] = np.argpartition(d, near - 1, 1)[:, :near] if k > 1 else 0
        self.links = np.concatenate([links, rng.integers(k, size=(k, 4))], 1)
        self.entries = rng.choice(k, min(ENTRIES, k), replace=False)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the want nearest centroids found and their squared distances, nearest first: best-first search of all rows at once."""
        q = q.astype(np.float32)
        n, k = len(q), len(self.c)
        beam = min(max(BEAM, want), k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        dist = np.full((n, beam), np.inf, np.float32)
        ids = np.zeros((n, beam), np.int64)
        open_ = np.zeros((n, beam), bool)
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            d = self.half[new] - np.einsum("nkd,nd->nk", self.c[new], q)
            d[seen[rows, new]] = np.inf
            seen[rows, new] = True
            dist = np.concatenate([dist, d], 1)
            ids = np.concatenate([ids, new], 1)
            open_ = np.concatenate([open_, np.isfinite(d)], 1)
            best = np.argsort(dist, 1, kind="stable")[:, :beam]
            dist, ids, open_ = dist[rows, best], ids[rows, best], open_[rows, best]
            if not open_.any():
                break
            first = np.argsort(~open_, 1, kind="stable")[:, :4]  # the nearest four not looked at yet
            open_[rows, first] = False
            new = self.links[ids[rows, first]].reshape(n, -1)
            order = np.sort(new, 1)  # the same neighbour twice counts once
            order[:, 1:][order[:, 1:] == order[:, :-1]] = self.entries[0]
            new = order
        own = (q * q).sum(1, keepdims=True)
        return ids[:, :want], np.maximum(2 * dist[:, :want] + own, 0)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of all centroids, for the few queries that an index is fitted to."""
        return np.maximum(2 * (self.half - q.astype(np.float32) @ self.c.T) + (q * q).sum(1, keepdims=True), 0)


def usable(v: Column) -> Column:
    """Not null, not all zero, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1, keepdims=True), 0))], 1)


class Index:
    def __init__(self, vectors: DataFrame):
        """vectors: (id, v), usable and of one length."""
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        n, longest = vectors.agg(F.count("*"), F.max(norm)).first()
        self.longest = longest or 0.0
        k = max(1, min(MOST_CENTROIDS, -(-n // LIST)))
        sample = vectors.select("v", F.xxhash64(F.lit(5), "id", "v").alias("h")).orderBy("h").limit(min(MOST_SAMPLE, 64 * k)).select("v").toArrow()
        rng = np.random.default_rng(7)
        lifted = _lifted(_matrix(sample["v"]), self.longest)
        self.graph = Graph(balanced(lifted, k, rng), rng)
        self.closure = CLOSURE
        if len(self.graph.c) > 1:
            _, d = self.graph.search(lifted[:8192], 2)
            self.closure = min(CLOSURE, float(np.quantile(np.sqrt(d[:, 1] / np.maximum(d[:, 0], 1e-12)), BOUNDARY)))
        self.width, self.ratio, self.floor = len(self.graph.c), np.inf, 0.0

    def posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of vectors and which of them count."""
        ids, d = self.graph.search(_lifted(x, self.longest), REPLICAS)
        return ids, self._within(d, self.closure)

    def read(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of queries and which of them are read."""
        ids, d = self.graph.search(np.concatenate([x, np.zeros((len(x), 1))], 1), self.width)
        ok = self._within(d, self.ratio, self.floor)
        ok[:, :LEAST] |= np.isfinite(d[:, :LEAST])
        return ids, ok

    @staticmethod
    def _within(d: np.ndarray, ratio: float, floor: float = 1e-12) -> np.ndarray:
        """d: squared distances, the nearest first."""
        ok = np.isfinite(d) & (d <= np.maximum(d[:, :1], floor) * ratio**2)
        ok[:, 0] = True
        return ok


def _neighbours(rows: DataFrame, asked: pa.Table, k: int) -> pa.Table:
    """(a, v): the vectors of the k nearest rows of each sampled query, by brute force; at most MOST_ASKED * k lines."""
    ids, x = asked["id"].to_numpy(), _matrix(asked["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                score = np.where(ids[:, None] == batch["id"].to_numpy(zero_copy_only=False)[None, :], -np.inf, x @ _matrix(batch["v"]).T)
                n = min(k, batch.num_rows)
                at = np.argpartition(-score, n - 1, 1)[:, :n]
                a, at = np.repeat(np.arange(len(x)), n), at.ravel()
                ok = np.isfinite(score[a, at])
                a, at = a[ok], at[ok]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(score[a, at]), batch["v"].take(pa.array(at))], ["a", "s", "v"])

    order = W.Window.partitionBy("a").orderBy(F.desc("s"))
    best = rows.select("id", "v").mapInArrow(run, f"a int, s double, v {rows.schema['v'].dataType.simpleString()}")
    return best.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).select("a", "v").toArrow()


def fitted(index: Index, rows: DataFrame, k: int) -> Index:
    """index with the width of the search and the ratio of distances that RECALL takes, and the floor of the nearest distance."""
    each_once = rows.filter("q").groupBy(F.xxhash64(F.lit(6), "v").alias("h")).agg(F.min(F.struct("id", "v")).alias("x"))  # a vector that many queries have counts once
    asked = each_once.orderBy("h").limit(MOST_ASKED).select("x.id", "x.v").toArrow()
    near = _neighbours(rows, asked, k) if asked.num_rows else asked
    if not near.num_rows:
        return index
    x, centroids = _matrix(asked["v"]), len(index.graph.c)
    distance = index.graph.distances(np.concatenate([x, np.zeros((len(x), 1))], 1))  # at most MOST_ASKED * MOST_CENTROIDS
    rank, nearest_ = np.argsort(np.argsort(distance, 1, kind="stable"), 1), distance.min(1)
    index.floor = float(np.median(nearest_)) / 4
    held, posted = index.posted(_matrix(near["v"]))
    of = near["a"].to_numpy()[:, None]
    first = np.where(posted, rank[of, held], centroids)  # the neighbour's list that its query comes to first
    best = first.argmin(1)
    ratio = np.sqrt(distance[of[:, 0], held[np.arange(len(held)), best]] / np.maximum(nearest_[of[:, 0]], index.floor))
    each = lambda x: np.sort(x)[int(np.ceil((1 + RECALL) / 2 * len(x))) - 1]  # noqa: E731  # each of the two lets half of the rest go
    index.width = int(min(centroids, max(LISTS, each(first.min(1)) + 1)))
    index.ratio = float(max(1.0, each(ratio))) * (1 + 1e-6)
    return index


def _lists(index, query: bool):
    """mapInArrow function: (id, v, ...) -> the same rows once for each list they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = 256 if query else 1024
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                ids, ok = (index.value.read if query else index.value.posted)(_matrix(batch["v"]))
                row, at = np.nonzero(ok)
                got = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, at].astype(np.int32)), pa.array(at.astype(np.int32)), *got.columns], ["list", "place", *got.schema.names])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col and score of the k nearest of each query row."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    out = f"q {kind}, qk long, id {kind}, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    rows = stored(rows.groupBy("id", "v").agg(F.max("q").alias("q")), "vectors")
    index = spark.sparkContext.broadcast(fitted(Index(rows.select("id", "v")), rows, k))
    element = vectors.schema[vector_col].dataType.simpleString()
    posted = stored(rows.select("id", "v").mapInArrow(_lists(index, False), f"list int, place int, id {kind}, v {element}").drop("place"), "postings")
    asked = rows.filter("q").select("id", "v").withColumn("qk", F.xxhash64("id", "v")).dropDuplicates(["qk", "id"])
    asked = stored(asked.mapInArrow(_lists(index, True), f"list int, place int, id {kind}, v {element}, qk long"), "asked")
    def compare(held: pa.Table, queries: pa.Table) -> pa.Table:
        schema = [("q", queries.schema.field("id").type), ("qk", pa.int64()), ("id", queries.schema.field("id").type), ("score", pa.float64())]
        if not held.num_rows or not queries.num_rows:
            return pa.Table.from_batches([], pa.schema(schema))
        held = held.sort_by("id")
        x = _matrix(held["v"])
        ids = held["id"].to_numpy()
        again = np.r_[False, ids[1:] == ids[:-1]]  # other vectors of one id
        some = []
        for lo in range(0, queries.num_rows, 128):
            part = queries.slice(lo, 128)
            score = np.einsum("ij,kj->ik", _matrix(part["v"]), x)
            own = (part["id"].to_numpy()[:, None] == ids[None, :]) | (score < part["least"].to_numpy()[:, None])
            order = np.argsort(np.where(own, np.inf, -score), 1, kind="stable")  # stable: equal scores by id
            if again.any():  # those of one score are one candidate, so they go last
                s = np.take_along_axis(score, order, 1)
                same = np.c_[np.zeros(len(order), bool), (ids[order][:, 1:] == ids[order][:, :-1]) & (s[:, 1:] == s[:, :-1])]
                order = np.take_along_axis(order, np.argsort(same, 1, kind="stable"), 1)
            order = order[:, : k + 1]
            row = np.repeat(np.arange(part.num_rows), order.shape[1])
            at = order.ravel()
            ok = ~own[row, at]
            row, at = row[ok], at[ok]
            some.append((part["id"].to_numpy()[row], part["qk"].to_numpy()[row], held["id"].to_numpy()[at], score[row, at]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, (_, t) in zip(zip(*some), schema)], [n for n, _ in schema])

    def compared(queries: DataFrame) -> DataFrame:
        """The best candidates that each list has for its queries (list, id, qk, v, least)."""
        parts = posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        blocks = queries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        both = F.broadcast(parts.join(blocks, "list"))  # a line for each centroid at most
        left = posted.join(both, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "part", "block", "id", "v")
        right = queries.join(both, "list").withColumn("block", F.pmod(F.col("qk"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "block", "id", "qk", "v", "least")
        return left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInArrow(compare, out)

    order = W.Window.partitionBy("q", "qk").orderBy(F.desc("score"), "id")
    # a vector posted to several lists has one score; equal ids of different vectors have their own
    best = lambda pairs: pairs.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = stored(best(compared(asked.filter(F.col("place") < LEAST).withColumn("least", F.lit(float("-inf"))))), "first")
    reached = first.filter(F.col("rank") == k).select(F.col("q").alias("id"), "qk", F.col("score").alias("least"))
    others = asked.filter(F.col("place") >= LEAST).join(reached, ["id", "qk"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    ranked = best(first.drop("rank").unionByName(compared(others)))
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
