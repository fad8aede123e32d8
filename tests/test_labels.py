"""Labels and listings: edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import labels
from loomline.operators import listing


def test_labels(spark):
    rows = [(1, "59.5", 1.0), (11, "x", 1023.0), (21, None, 1280.0), (-2, "0", 1024.0**5), (1234567, "60.5", 0.0), (None, "-4", None)]
    n, s, b = F.col("n"), F.col("s"), F.col("b")
    got = spark.createDataFrame(rows, "n long, s string, b double").select(labels.plural(n, "a", "b", "c"), labels.number(n), labels.duration(s), labels.size(b), labels.bar(n, F.lit(21))).collect()
    assert [r[0] for r in got] == ["a", "c", "a", "b", "c", None]
    assert [r[1] for r in got] == ["1", "11", "21", "-2", "1 234 567", None]
    assert [r[2] for r in got] == ["1:00", "", "", "", "1:00", ""]
    assert [r[3] for r in got] == ["1 Б", "1023 Б", "1.2 КБ", "1024.0 ТБ", "0 Б", None]
    assert [r[4] for r in got][:4] == [8, 27, 46, None]


def test_listings(spark):
    raw = [('{"counters":{"a":1},"likes":[1],"gifts":[1,2]}',), ("{}",), ("no json",), (None,), ('{"gifts":3}',), ('{"gifts":[]}',)]
    got = spark.createDataFrame(raw, "r string").select(listing.live_stats(F.col("r")).alias("s")).select("s.*").collect()
    assert [(r["counters"], r["likes"], r["gifts"]) for r in got] == [('{"a":1}', None, 2), (None, None, None), (None, None, None), (None, None, None), (None, None, None), (None, None, 0)]
    posts = spark.createDataFrame([(1, 5), (2, 4), (3, None)], "id long, at long")
    assert {r["id"]: r["unlisted"] for r in listing.unlisted(posts, "at").collect()} == {1: False, 2: True, 3: False}
    assert listing.unlisted(posts.filter("id > 9"), "at").count() == 0
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"c": 1}), ({"d": 1}, None)], "x map<string,long>, y map<string,long>")
    assert [r[0] for r in maps.select(listing.overlaid(F.col("x"), F.col("y"))).collect()] == [{"a": 1, "b": 3}, {"c": 1}, {"d": 1}]


def test_accumulated(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    fresh = spark.createDataFrame([("b", None), ("c", 5), (None, 6)], "k string, v int")
    got = {r["k"]: (r["v"], r["retired"]) for r in listing.accumulated(known, fresh, "k").collect()}
    assert got == {"a": (1, True), "b": (None, False), "c": (5, False), None: (6, False)}
    again = listing.accumulated(listing.accumulated(known, fresh, "k"), known, "k")
    assert {r["k"]: r["retired"] for r in again.collect()} == {"a": False, "b": False, "c": True, None: False}
    assert listing.accumulated(known.filter("v > 9"), fresh.filter("v > 9"), "k").count() == 0


def test_changed_since(spark, tmp_path):
    import os

    from loomline.sources.raw import changed_since

    for name, at in (("old.json", 1_000_000_000), ("new.json", 1_700_000_000), ("new.txt", 1_700_000_000)):
        (tmp_path / "x").mkdir(exist_ok=True)
        (tmp_path / "x" / name).write_text("{}")
        os.utime(tmp_path / "x" / name, (at, at))
    got = changed_since(spark, str(tmp_path), "2020-01-01T00:00:00").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in got] == [("new.json", 2)]
