"""Centroid clustering of integer vectors, with block-norm screening before exact distances.

A component x becomes floor(SCALE * x). A vector v is also kept compressed: v = step * codes + rest, with codes of one byte, a step that is a
power of two, and the norm of the rest in each of SEGMENTS runs of components. By Cauchy-Schwarz in every run, for a centroid c,
|v - c|^2 >= |v|^2 + |c|^2 - 2 * (step * codes . c + sum over runs of |rest| * |c|), so the bounds of a batch are two matrix products over
compressed vectors. Each vector gets the exact distance of the centroid that its codes put nearest, then of those centroids alone whose bound
does not exceed the best exact distance so far. A margin above the rounding error of the bounds keeps the result that of comparing with all
centroids, ties included.

Both forms are written once. A round is one pass over them: a task adds up components by cluster, so it emits a line a cluster and
component whatever it read, and the lines are summed by Spark in decimals. Only k * dim sums (k is a parameter) reach the driver, as the model.

Defined results: vectors that are null, of another length than dim, or hold null or non-finite components take no part; components beyond
+-MOST, whose distances would leave 64 bits, count as +-MOST; a null id hashes as `null`; of equal ids the one whose integers, as bytes, come first is the earlier
seed; repeated rows all take part; fewer vectors than k give as many centroids; an empty table gives an empty result; sums beyond 64 bits
end at 2**63 - 1. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomline.llm.common import stored

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
SEGMENTS = 8
#: |component|: 64 squared differences of such components stay below 2**63.
MOST = 1 << 27
#: Above the rounding error of a bound, relative to the squared norms.
MARGIN = 1e-9


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integers)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is NaN here
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(x[fine] * SCALE), -MOST, MOST).astype(np.int32)


def segment_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.reshape(len(x), SEGMENTS, x.shape[1] // SEGMENTS) ** 2).sum(2))


def compressed(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of integer vectors: codes, log2 of the step, norms of the rest by segment (rounded up), squared norm."""
    x = q.astype(np.float64)
    shift = np.maximum(0, np.ceil(np.log2(np.maximum(1, np.abs(x).max(1)) / 127))).astype(np.int8) if len(x) else np.zeros(0, np.int8)
    step = np.exp2(shift.astype(np.float64))[:, None]
    codes = np.clip(np.rint(x / step), -127, 127)
    rest = segment_norms(x - codes * step) * (1 + 1e-6)
    return codes.astype(np.int8), shift, rest.astype(np.float32), (x**2).sum(1)


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, q (integers as bytes), and the compressed form: codes and rest (as bytes), shift, norm."""
    kind = vectors.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q = _integers(batch["v"], dim)
            if len(rows):
                codes, shift, rest, norm = compressed(q)
                columns = [batch["i"].take(pa.array(rows)).cast(arrow_kind), _bytes(q), _bytes(codes), _bytes(rest), pa.array(shift), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "q", "codes", "rest", "shift", "norm"])

    return vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).mapInArrow(pack, f"vec_id {kind.simpleString()}, q binary, codes binary, rest binary, shift byte, norm double")


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class Screen:
    """The centroids of a round, ready to be searched."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids.astype(np.int64)
        self.float = centroids.astype(np.float64)
        self.segments = segment_norms(self.float)
        self.norms = (self.float**2).sum(1)
        self.compared = 0

    def nearest(self, q: np.ndarray, codes: np.ndarray, shift: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, exact squared distance) of each vector; of equally near ones the smaller number."""
        both = norm[:, None] + self.norms
        guess = both - 2 * np.exp2(shift.astype(np.float64))[:, None] * (codes.astype(np.float64) @ self.float.T)
        first = guess.argmin(1)
        bound = guess - 2 * (rest.astype(np.float64) @ self.segments.T) - MARGIN * both - 1
        best, near = ((q.astype(np.int64) - self.exact[first]) ** 2).sum(1), first.copy()
        self.compared += len(q)
        for c in range(len(self.exact)):
            rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
            if len(rows):
                d = ((q[rows].astype(np.int64) - self.exact[c]) ** 2).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (c < near[rows]))
                best[rows[better]], near[rows[better]] = d[better], c
                self.compared += len(rows)
        return near, best

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(integers, centroid, distance) of a batch of packed vectors."""
        q = _matrix(batch["q"], np.int32)
        return q, *self.nearest(q, _matrix(batch["codes"], np.int8), batch["shift"].to_numpy(), _matrix(batch["rest"], np.float32), batch["norm"].to_numpy())


def seeds(table: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest seeded SHA-256, in order of it."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    found = [np.frombuffer(r["q"], np.int32) for r in table.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    return np.array(found, np.int64) if found else np.zeros((0, SEGMENTS), np.int64)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: componentwise floor of the mean of each one's vectors; one without vectors stays."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, sums, count = Screen(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                q, near, _ = screen.of(batch)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
                at = near[order][first]
                sums[at] += np.add.reduceat(q[order].astype(np.int64), first, axis=0)
                count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = table.drop("vec_id").mapInArrow(add, "c int, n long, s array<long>")
    lines = parts.select("c", F.posexplode(F.concat("s", F.array("n"))).alias("j", "x")).groupBy("c", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found = {(r["c"], r["j"]): int(r["x"]) for r in lines.collect()}
    return np.array([[found[c, j] // found[c, dim] for j in range(dim)] if (c, dim) in found else centroids[c] for c in range(k)], np.int64).reshape(k, dim)


def fitted(table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds over packed vectors."""
    centroids = seeds(table, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids)
    return centroids


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of packed vectors."""
    kind = to_arrow_type(table.schema["vec_id"].dataType)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            if len(batch):
                _, near, best = screen.of(batch)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(kind), pa.array(near.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    if dim % SEGMENTS:
        raise ValueError(f"dim must be a multiple of {SEGMENTS}")
    spark = vectors.sparkSession
    table = stored(packed(vectors, id_col, vector_col, dim), "vectors")
    centroids = fitted(table, k, rounds, seed)
    places = stored(assigned(table, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in places.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    limit, digest = (1 << 63) - 1, lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    lines = spark.createDataFrame(
        [(c, min(sums.get(c, 0), limit), min(sum(sums.values()), limit), digest(row)) for c, row in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )  # a line a centroid
    return places.join(F.broadcast(lines), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
