"""References, blobs and owners of media."""

from __future__ import annotations

from loomline.operators import media


def test_index_usage_and_owners(spark):
    refs = spark.createDataFrame([("a", "s1", "done"), ("b", "s1", "done"), ("c", "s2", "missing"), ("d", "s9", "done"), ("e", None, "pending"), ("f", None, "done"), ("g", None, "missing")], "key string, sha256 string, status string")
    blobs = spark.createDataFrame([("s1", 10, "jpg", "s1/x.jpg"), ("s2", 20, "png", "s2/y.png"), ("s3", 5, "gif", None)], "sha256 string, size long, mime string, path string")
    found = media.index(refs, blobs)
    got = {r["key"]: (r["path"], r["size"], r["missing"]) for r in found.collect()}
    assert got == {"a": ("media/s1/x.jpg", 10, False), "b": ("media/s1/x.jpg", 10, False), "c": (None, None, True), "g": (None, None, True)}
    uses = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("c", "p"), ("b", "q"), ("z", "q")], "key string, archive string")
    assert sorted(map(tuple, media.usage(uses, found).collect())) == [("p", 1, 10), ("q", 1, 10)]
    assert {r["key"]: r["owners"] for r in media.owners(uses.withColumnRenamed("archive", "owner")).collect()} == {"a": ["p"], "b": ["p", "q"], "c": ["p"], "z": ["q"]}
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 7)], "id long, author long")
    library = spark.createDataFrame([(5, "five"), (6, "six"), (6, "a six")], "uid long, name string")
    assert {r["id"]: r["other"] for r in media.others(rows, library, 5).collect()} == {1: None, 2: "a six", 3: None, 4: None}
