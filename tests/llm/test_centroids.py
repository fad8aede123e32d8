"""Centroid clustering against plain Lloyd rounds over integers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from loomline.llm import centroids, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, q string, b string, c int, cluster int, distance int, h int"


def plain(rows: list[tuple], k: int = 40, rounds: int = 5, dim: int = 64) -> dict:
    """Integers, seeds and rounds by comparing every vector with every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.MOST, min(centroids.MOST, math.floor(256 * float(np.float32(x))))) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    at = [list(q) for _, q in kept[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, q in kept:
            own[near(q)[1]].append(q)
        at = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(own, at)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = sum(d for _, _, d in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((str(i), c, d, sum(y for _, x, y in out if x == c), inertia, digest[c]) for i, c, d in out)


def got(df) -> list:
    return sorted((str(r["vec_id"]), *tuple(r)[1:]) for r in df.collect())


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, v, "x", None, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(parts)


def search(screen, q):
    return screen.nearest(q, *centroids.compressed(q))


def vectors(seed: int, n: int, spread: float = 0.1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(7, 64))
    return [(k * 3 - 50, (heart[rng.integers(7)] + rng.normal(size=64) * spread).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("seed,n,spread", [(0, 150, 0.1), (1, 90, 2.0), (2, 12, 0.3)])
def test_equals_plain_rounds(spark, seed, n, spread):
    rows = vectors(seed, n, spread)
    assert got(centroids.clustered(frame(spark, rows))) == plain(rows)


def test_ties_repeats_and_what_takes_no_part(spark):
    rows = vectors(5, 60)
    rows += rows[:9] + [(None, rows[3][1]), (None, rows[4][1]), (7000, [0.0] * 64), (7001, [0.0] * 64), (7002, [-0.001] * 64), (7003, [1e30] + [0.0] * 63), (7004, [-1e30] * 64)]
    rows += [(8000, None), (8001, []), (8002, [1.0] * 63), (8003, [1.0] * 65), (8004, [None] + [1.0] * 63), (8005, [math.nan] + [1.0] * 63), (8006, [math.inf] + [1.0] * 63)]
    assert got(centroids.clustered(frame(spark, rows))) == plain(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(100)]  # equal seeds: every distance is a tie
    out = centroids.clustered(frame(spark, rows))
    assert got(out) == plain(rows) and out.select("cluster").distinct().count() == 2


def test_empty_and_null_tables(spark):
    assert centroids.clustered(frame(spark, [(1, [0.0] * 64)]).limit(0)).collect() == []
    assert centroids.clustered(frame(spark, [(None, None), (None, None)])).collect() == []


def test_screening_is_exact_and_prunes():
    rows = vectors(9, 3000)
    q = np.floor(np.array([v for _, v in rows], np.float32).astype(np.float64) * 256).astype(np.int32)
    screen = centroids.Screen(q[:40].astype(np.int64))
    near, best = search(screen, q)
    d = ((q[:, None].astype(np.int64) - q[None, :40]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (best == d.min(1)).all()
    assert screen.compared < 0.25 * d.size


@pytest.mark.parametrize("size", [1, 1 << 10, centroids.MOST])
def test_bounds_hold_at_any_size(size):
    rng = np.random.default_rng(size)
    q = rng.integers(-size, size + 1, (400, 64)).astype(np.int32)
    q[::7] = q[3] + (size < centroids.MOST)
    screen = centroids.Screen(q[:40].astype(np.int64))
    near, best = search(screen, q)
    d = ((q[:, None].astype(np.int64) - q[None, :40]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (best == d.min(1)).all()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(queries.oracle_sql()["op12_centroids"]).fetchall())
    assert got(queries.op12_centroids(spark, SMALL)) == want
