"""Forests by pointer doubling against walks over dictionaries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import counting, forest


def walked(rows: list[tuple]) -> dict:
    """id -> (root, depth, pre, size) by depth-first walks; links to what is not there, or to itself, are none."""
    parent = {}
    for i, p, _ in rows:
        if i is not None:
            parent[i] = max(parent.get(i) or -1, -1 if p is None else p)
    date = {i: max(d for j, _, d in rows if j == i) for i in parent}
    parent = {i: p if p in parent and p != i else None for i, p in parent.items()}
    for i in sorted(parent):  # the smallest id of a cycle becomes a root
        j = parent[i]
        seen = set()
        while j is not None and j != i and j not in seen:
            seen.add(j)
            j = parent[j]
        if j == i:
            parent[i] = None
    kids = {i: sorted((date[j], j) for j in parent if parent[j] == i) for i in parent}
    out = {}

    def walk(root: int) -> None:
        place, stack, order = 0, [(root, 0)], []
        while stack:
            i, depth = stack.pop()
            out[i] = [root, depth, place, 1]
            order.append(i)
            place += 1
            stack += [(j, depth + 1) for _, j in reversed(kids[i])]
        for i in reversed(order):
            if parent[i] is not None:
                out[parent[i]][3] += out[i][3]

    for i, p in parent.items():
        if p is None:
            walk(i)
    return {i: tuple(x) for i, x in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, date long").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_walks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0, rng.randrange(1, i + 1), rng.randrange(1, 90), 500]), rng.randrange(4)) for i in range(1, 80)]
    got = {r["id"]: (r["root"], r["depth"], r["pre"], r["size"]) for r in forest.intervals(frame(spark, rows)).collect()}
    assert got == walked(rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, None, 5), (2, 1, 3), (2, 1, 3), (3, 1, 1), (3, None, 2), (None, 1, 1), (4, 4, 0)]
    got = {r["id"]: (r["root"], r["depth"], r["pre"], r["size"]) for r in forest.intervals(frame(spark, rows)).collect()}
    assert got == walked(rows) == {1: (1, 0, 0, 3), 3: (1, 1, 1, 1), 2: (1, 1, 2, 1), 4: (4, 0, 0, 1)}
    assert forest.intervals(frame(spark, rows).limit(0)).collect() == [] and forest.keep(frame(spark, rows).limit(0), spark.range(2)).collect() == []


def test_cycles_end_at_their_smallest_id(spark):
    rows = [(1, 2, 0), (2, 3, 0), (3, 1, 0), (4, 3, 0), (5, 4, 0), (8, 7, 0), (7, 8, 0)]
    got = {r["id"]: (r["root"], r["depth"], r["pre"], r["size"]) for r in forest.intervals(frame(spark, rows)).collect()}
    assert got == walked(rows) and {i for i, x in got.items() if x[1] == 0} == {1, 7}


def test_a_chain_takes_linear_rows(spark):
    n = 100_000
    chain = spark.range(1, n + 1).selectExpr("id", "id - 1 as parent", "0L as date")
    out = forest.intervals(chain)
    assert out.filter("depth = id - 1 and pre = id - 1 and root = 1").filter(F.col("size") == n + 1 - F.col("id")).count() == n
    short = chain.filter("id <= 2000")
    assert forest.keep(short, spark.createDataFrame([(1700,)], "id long")).count() == 2000


def test_a_star_and_pruning(spark):
    star = spark.range(1, 5001).selectExpr("id", "CASE WHEN id > 1 THEN 1 END parent", "-id as date")
    out = {r["id"]: r["pre"] for r in forest.intervals(star).collect()}
    assert out[1] == 0 and all(out[i] == 5001 - i for i in range(2, 5001))
    assert sorted(r[0] for r in forest.keep(star, spark.createDataFrame([(7,), (9,), (9,), (99_999,)], "id long")).collect()) == [1, 7, 9]


def test_sums_above_and_below(spark):
    tree = forest.tidy(spark.createDataFrame([(1, None, 1, None), (2, 1, 10, 3), (3, 2, 100, 4), (4, 2, 1000, None)], "id long, parent long, a long, b long"))
    got = {r["id"]: (r["above_a"], r["below_a"], r["below_b"]) for r in forest.climbed(tree, above=("a",), below=("a", "b")).collect()}
    assert got == {1: (0, 1111, 7), 2: (1, 1110, 7), 3: (11, 100, 4), 4: (11, 1000, 0)}


def test_ranged_sum_over_many_ranges(spark):
    rows = spark.range(0, 300_000, numPartitions=9).selectExpr("id", "id % 7 as size", "repeat('x', 20) as other")
    out = counting.ranged_sum(rows, [F.desc("id")], "size", "before")
    first = out.filter("id in (299999, 150000, 0)").select("id", "before").collect()
    want = {i: sum(k % 7 for k in range(i + 1, 300_000)) for i in (299_999, 150_000, 0)}
    assert {r["id"]: r["before"] for r in first} == want


def above(parent: dict) -> dict:
    """(id, ancestor) -> distance, by walks that end at the first repeat."""
    out = {}
    for i in parent:
        seen, j, n = {i}, parent[i], 1
        while j not in (None, 0) and j not in seen:
            out[i, j] = n
            seen.add(j)
            j, n = parent.get(j), n + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_and_shown_equal_walks(spark, seed):
    """With cycles, ways that end outside, and ids of two rows."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0, i, rng.randrange(1, i + 1), max(i - 1, 1), max(i - 1, 1), rng.randrange(1, 60), 500])) for i in range(1, 50)] + [(7, 3), (90, 91), (91, 92), (92, 90), (93, 92), (94, 93)]
    edges = spark.createDataFrame(rows, "id long, parent long").repartition(3)
    parent = {i: max((p for j, p in rows if j == i and p is not None), default=None) for i, _ in rows}
    pairs = above({i: None if p == i else p for i, p in parent.items()})
    assert {(r["id"], r["ancestor"]): r["up"] for r in forest.ancestors(edges).collect()} == pairs and forest.ancestors(edges).count() == len(pairs)
    mine = [(17, 1), (30, 1), (45, 2), (92, 2), (500, 2), (700, 1), (17, 1)]
    want = {}
    for g in (1, 2):
        own = {i for i, x in mine if x == g}
        nodes = (own | {a for i, a in pairs if i in own} | {i for i, a in pairs if a in own}) & set(parent)
        ends = {i for i in nodes if i in own or sum(parent[j] == i for j in nodes) != 1}
        want |= {(g, i): i not in ends and not any((i, e) in pairs for e in ends) for i in nodes}
    got = forest.shown(edges, spark.createDataFrame(mine, "id long, grp long")).collect()
    assert {(r["grp"], r["id"]): r["chain"] for r in got} == want and len(got) == len(want)


def test_a_long_chain_is_shown_without_its_pairs(spark):
    """200 million pairs of a node and one above; rows here are those of the nodes."""
    n = 20_000
    chain = spark.range(1, n + 1).selectExpr("id", "id - 1 as parent")
    out = forest.shown(chain, spark.createDataFrame([(15_000, 0)], "id long, grp long"))
    assert out.count() == n and out.filter("chain").count() == 14_999
    assert "UnionLoop" not in forest.ancestors(chain.filter("id < 9"))._jdf.queryExecution().toString()
