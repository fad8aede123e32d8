"""The table that batches are merged into, bucket by bucket."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from loomline.sources import buckets, sinks
from loomline.streaming import history

SCHEMA = "id long, at long, v string"


def files(root: Path) -> dict:
    return {str(p): os.stat(p).st_mtime_ns for p in (root / "data").rglob("*.parquet")}


def rows(table) -> list[tuple]:
    return sorted(map(tuple, table.read().collect()))


def test_a_batch_rewrites_only_the_buckets_it_changes(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "id", ("at",), buckets=8)
    with pytest.raises(ValueError):
        t.read()
    first = spark.range(200).selectExpr("id", "1L as at", "'a' as v")
    assert t.merge(first, 0) == {"buckets": 8, "rewritten": 8, "events": 200} and t.read().count() == 200
    before = files(tmp_path / "t")
    change = spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (5, 1, "z"), (900, 1, "new")], SCHEMA)
    got = t.merge(change, 1)
    assert got["rewritten"] <= 2 and got["events"] == 2
    after = files(tmp_path / "t")
    assert all(after[p] == at for p, at in before.items()) and len(after) - len(before) == got["rewritten"]  # nothing that was written is touched
    named = set(t.state()[1]["folders"].values())
    assert sum(any(f in p for f in named) for p in before) == 8 - got["rewritten"]
    assert {r for r in rows(t) if r[0] in (5, 900)} == {(5, 3, "c"), (900, 1, "new")} and t.read().count() == 201
    # the same number again, and the same rows under a new number
    assert t.merge(change, 1) == {"buckets": 0, "rewritten": 0, "events": 0}
    assert t.merge(change, 2)["rewritten"] == 0 and files(tmp_path / "t") == after
    assert {(r["batch"], r["id"], r["event"]) for r in t.events().filter("batch > 0").collect()} == {(1, "5", "update"), (1, "900", "insert")}


def test_the_latest_row_is_defined_by_the_order(spark, tmp_path):
    batch = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 4, "zz"), (None, 9, "none"), (2, None, "n"), (2, 0, "m")], SCHEMA)
    for k in range(3):
        t = buckets.BucketTable(spark, str(tmp_path / f"t{k}"), "id", ("at",), buckets=2)
        t.merge(batch.repartition(k + 1), 0)
        assert rows(t) == [(1, 5, "y"), (2, 0, "m")]
    assert t.merge(batch.limit(0), 1) == {"buckets": 0, "rewritten": 0, "events": 0}


def test_what_is_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "id", ("at",), buckets=4)
    t.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    monkeypatch.setattr(buckets, "commit", lambda *a: False)  # another writer was first, or the driver died here
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], SCHEMA), 1)
    monkeypatch.undo()
    assert rows(t) == [(1, 1, "a")] and t.events().filter("batch = 1").count() == 0
    t.merge(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], SCHEMA), 1)
    assert rows(t) == [(1, 2, "b"), (2, 2, "b")] and t.events().filter("batch = 1").count() == 2


def test_buckets_split(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "id", ("at",), buckets=2, most=30)
    for k in range(3):
        t.merge(spark.range(k * 40, k * 40 + 40).selectExpr("id", "1L as at", "'a' as v"), k)
    assert t.state()[1]["buckets"] > 2 and [r[0] for r in rows(t)] == list(range(120))
    assert t.merge(spark.createDataFrame([(7, 2, "b")], SCHEMA), 3)["rewritten"] == 1 and rows(t)[7] == (7, 2, "b")


def test_a_stream_follows(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "id", ("at",), buckets=4)
    for k in range(2):
        spark.createDataFrame([(1, k, f"v{k}"), (10 + k, k, "w")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        t.follow(history.landed(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(t) == [(1, 1, "v1"), (10, 0, "w"), (11, 1, "w")]


def test_own_comments_from_a_feed(spark, tmp_path):
    schema = "id long, author long, text string, stub string, media boolean, sig string, damaged boolean, state string, state_at long, at long"
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "id", ("at",), buckets=4)
    rule = buckets.feed_rule(7, 99)
    row = lambda i, text, author=7, stub=None, sig=None, damaged=False, state=None, at=1: (i, author, text, stub, False, sig or text, damaged, state, None, at)
    old = [row(1, "one"), row(2, "two" * 20), row(3, "three"), row(4, "four", state="gone"), row(5, "", damaged=True), row(6, "six")]
    t.merge(spark.createDataFrame(old, schema), 0)
    t.merge(spark.createDataFrame([row(9, "theirs", author=8)], schema), 0, "feed", rule)
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2, 3, 4, 5, 6]
    new = [row(1, "", stub="removed", at=2), row(2, ".", at=2), row(3, "three!", at=2), row(4, "four", at=2), row(5, "five", at=2), row(6, "six", author=8, at=2), row(8, "eight", author=None, at=2)]
    t.merge(spark.createDataFrame(new, schema), 1, "feed", rule)
    got = {r["id"]: (r["text"], r["state"], r["state_at"]) for r in t.read().collect()}
    assert got == {1: ("one", "removed", 99), 2: ("two" * 20, "wiped", 99), 3: ("three!", None, None), 4: ("four", None, None), 5: ("five", None, None), 6: ("six", None, None), 8: ("eight", None, None)}
    told = {(r["id"], r["event"]) for r in t.events().filter("batch = 1").collect()}
    assert told == {("1", "removed"), ("2", "removed"), ("3", "edit"), ("4", "restored"), ("5", "found"), ("8", "insert")}
    again = t.merge(spark.createDataFrame(new, schema), 2, "feed", buckets.feed_rule(7, 100))
    assert again["rewritten"] == 0 and again["events"] == 0


def test_publishing_never_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "p")
    assert sinks.current(spark, root) is None
    df = spark.range(3)
    one = sinks.publish({"a": df}, root)
    two = sinks.publish({"a": df}, root)
    assert one != two and sinks.current(spark, root) == two
    assert sinks.committed(spark, f"{root}/current")[0] == 2 and not sinks.commit(spark, f"{root}/current", 2, {"version": "x"})
    (tmp_path / "p/current/.000000000003-x").write_text("half of an entr")  # a writer that died
    assert sinks.current(spark, root) == two
