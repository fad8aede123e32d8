"""Exact dedup, n-gram Jaccard join, substring dedup."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bloom, exact_dedup, jaccard_join, substring_dedup
from loomline.llm.common import HOT_SHARE


def test_exact_copies(docs, rows):
    got = exact_dedup.annotate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert {tuple(r) for r in got} == brute.exact_copies([(i, t) for i, t, _ in rows]) and len(got) == len(rows)


def test_exact_dedup_keeps_whole_rows(docs, rows):
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {x[0] for x in brute.exact_copies([(i, t) for i, t, _ in rows]) if x[3]}


def test_exact_dedup_of_repeated_rows_and_nulls(docs, nulls, empty):
    twice = docs.unionByName(docs)
    assert exact_dedup.deduplicate(twice).count() == exact_dedup.deduplicate(docs).count()
    assert exact_dedup.annotate(twice).filter("kept").count() == exact_dedup.annotate(docs).filter("kept").count()
    assert [tuple(r)[1:4] for r in exact_dedup.annotate(nulls).filter("kept").collect()] == [(None, 3, True)]
    assert exact_dedup.deduplicate(nulls).count() == 1
    assert exact_dedup.annotate(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.annotate(df)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 and keep_id = 2997").count() == 1000


def test_exact_dedup_with_a_filter_a_range(docs, rows, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 8)
    want = brute.exact_copies([(i, t) for i, t, _ in rows])
    assert {tuple(r) for r in exact_dedup.annotate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == want
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()) == sorted(x[0] for x in want if x[3])


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(0, 50_000, 1, 7).select(F.xxhash64("id").alias("h"))
    held = np.array([r["h"] for r in keys.collect()])
    assert bloom.has(bloom.build(keys, 50_000), held).all()
    again = bloom.build(keys.unionByName(keys.limit(100)), 50_100, repeated=True)
    assert bloom.has(again, np.array([r["h"] for r in keys.limit(100).collect()])).all() and bloom.has(again, held).mean() < 0.1


def components(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_components(docs, rows):
    got = components(jaccard_join.linked(docs))
    assert got == brute.near_components([(i, t) for i, t, _ in rows])
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize(("seed", "most"), [(1, jaccard_join.MOST), (2, jaccard_join.MOST), (1, 200), (2, 90)])
def test_near_components_of_close_cases(spark, monkeypatch, seed, most):
    """Texts of a small vocabulary, changed step by step: similarities on both sides of the threshold, and chains of links. Also with large
    families, which are dealt to blocks."""
    import random

    monkeypatch.setattr(jaccard_join, "MOST", most)

    rng = random.Random(seed)
    rows, w = [], [f"a{rng.randrange(30)}" for _ in range(60)]
    for i in range(90):
        if i % 15 == 0:
            w = [f"a{rng.randrange(30)}" for _ in range(rng.randint(8, 70))]
        w = list(w)
        w[rng.randrange(len(w))] = f"b{rng.randrange(9)}"
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "z")
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert components(jaccard_join.linked(df)) == brute.near_components(rows)


@pytest.mark.parametrize("most", [jaccard_join.MOST, 400])
def test_near_components_with_frequent_shingles(spark, monkeypatch, most):
    """Also with families dealt to blocks."""
    monkeypatch.setattr(jaccard_join, "MOST", most)
    head = " ".join(f"h{k}" for k in range(40))
    rows = [(i, f"{head} {' '.join(f'v{i % 7}x{k}' for k in range(i % 30))} u{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert components(jaccard_join.linked(df)) == brute.near_components(rows)


def test_near_copies_edges(docs, rows, nulls, empty):
    kept = jaccard_join.one_of_each(docs)
    want = brute.near_components([(i, t) for i, t, _ in rows])
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert [tuple(r)[:3] for r in jaccard_join.linked(nulls).collect()] == [(None, 0, None)] * 3
    assert jaccard_join.linked(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0
    twice = jaccard_join.linked(docs.unionByName(docs))
    assert twice.count() == 2 * len(rows) and components(twice) == want


def test_near_components_broadcast_nothing_that_grows(spark):
    """Rows broadcast by any statement: none but those of hot groups (fewer than 2 / HOT_SHARE), though all tables are under Spark's own threshold."""
    texts = {2 * i + j: " ".join(f"p{i}w{k}" for k in range(12 + j)) for i in range(1300) for j in (0, 1)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    store = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in _listed(store.executionsList())}
    got = components(jaccard_join.linked(df))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {i: (len(t.split()) - 4, i - i % 2) for i, t in texts.items()}
    sent = []
    for run in _listed(store.executionsList()):
        if run.executionId() not in before:
            values = store.executionMetrics(run.executionId())
            for node in _listed(store.planGraph(run.executionId()).allNodes()):
                if node.name().startswith("BroadcastExchange"):
                    found = [values.get(m.accumulatorId()) for m in _listed(node.metrics()) if m.name() == "number of output rows"]
                    sent += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    assert max(sent, default=0) < 2 / HOT_SHARE


def _listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def test_rounds_of_components_leave_the_plan_as_small(spark):
    """A chain, so many rounds: the size that Spark expects does not double in digits with each."""
    links = spark.range(64).select((F.col("id") * 7919 % 100_003).alias("a"), ((F.col("id") + 1) * 7919 % 100_003).alias("b"))
    found = jaccard_join.components(links)
    assert found.count() == 65 and {r["root"] for r in found.collect()} == {0}
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40


def test_divide_skip_reports_all_that_can_reach_the_overlap():
    import random

    rng = random.Random(5)
    for _ in range(300):
        n, docs = rng.randint(1, 40), rng.randint(1, 12)
        share = rng.random()
        lists = [sorted(x for x in range(docs) if rng.random() < share) for _ in range(n)]
        lists = [x for x in lists if x]
        need = jaccard_join.at_least(n, 75)
        got = list(jaccard_join.divide_skip(lists, n, 75))
        times = {d: t + sum(d in x for x in probe) for d, t, probe in got}
        assert len(times) == len(got) and all(t == sum(d in x for x in lists) for d, t in times.items())
        assert {d for d, t in times.items() if t >= need} == {d for d in range(docs) if sum(d in x for x in lists) >= need}


def test_near_copies_of_one_group_are_linear_in_edges():
    import random

    rng = random.Random(2)
    base = list(range(200))
    items = []
    for k in range(400):
        mine = base.copy()
        for at in rng.sample(range(200), rng.choice([2, 10, 30])):
            mine[at] = 1000 + 200 * k + at
        items.append(np.sort(np.array(mine, np.uint64)))
    every = np.ones(400, bool)
    edges = jaccard_join.search(items, np.arange(400), every, every, 75)
    forest, want = jaccard_join.Forest(400), jaccard_join.Forest(400)
    for x, y in edges:
        assert forest.join(x, y)  # no edge within a component
    for x in range(400):
        for y in range(x):
            both = len(np.intersect1d(items[x], items[y]))
            if 100 * both >= 75 * (400 - both):
                want.join(x, y)
    assert [forest.root(x) for x in range(400)] == [want.root(x) for x in range(400)]


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, equal ids, null ids."""
    a = " ".join(f"w{k}" for k in range(60))
    b, c = a + " more", a + " other words"
    rows = [(1, a, "x"), (1, a, "y"), (2, b, "x"), (None, c, "x"), (7, "alone here", "x"), (7, "alone here", "y"), (8, "", "x"), (8, None, "y"), (9, "q r s t u v", "x"), (9, "q r s t u v w x y z", "x")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, a), (7, "alone here"), (8, ""), (9, "q r s t u v"), (9, "q r s t u v w x y z")]
    same = spark.createDataFrame([(None, a, "x"), (None, b, "x"), (None, c, "x")], "doc_id long, text string, source string")
    assert jaccard_join.one_of_each(same).count() == 1
    equal = spark.createDataFrame([(3, a, "x"), (3, b, "x"), (4, c, "x")], "doc_id long, text string, source string")
    assert [r["doc_id"] for r in jaccard_join.one_of_each(equal).collect()] == [3]


def cut(df) -> dict:
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


def test_repeated_passages(docs, rows):
    got = cut(substring_dedup.trimmed(docs))
    assert got == brute.cut_repeats([(i, t) for i, t, _ in rows])
    assert any(g[1] for g in got.values())


@pytest.mark.parametrize("overlap", [33, 34, 35, 36, 57])
def test_passages_at_any_offset(spark, overlap):
    """A shared run of words just under, at and over the window, at all offsets modulo the period."""
    run = " ".join(f"r{k}" for k in range(overlap))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i)) + f" {run} " + f"e{i}") for i in range(24)]
    got = cut(substring_dedup.trimmed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {g[1] for g in got.values()} == {overlap if overlap >= 35 else 0}


def test_passage_within_one_document_and_digest(spark):
    run = " ".join(f"r{k}" for k in range(40))
    rows = [(1, f"{run} mid {run}"), (2, "Ab " * 36), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(substring_dedup.trimmed(df)) == brute.cut_repeats(rows) and cut(substring_dedup.trimmed(df))[1] == (81, 80, "mid")
    assert {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.trimmed(df, digest=True).collect()}[1] == brute.sha("mid")


def test_passages_edges(docs, nulls, empty):
    assert substring_dedup.trimmed(empty).count() == 0
    assert {tuple(r) for r in substring_dedup.trimmed(nulls).collect()} == {(None, 0, 0, "")}
    twice = {r["doc_id"]: r for r in substring_dedup.trimmed(docs.unionByName(docs)).collect()}
    assert all(r["n_removed"] == (r["n_words"] if r["n_words"] >= 35 else 0) for r in twice.values())
