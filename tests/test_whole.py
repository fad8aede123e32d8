"""Queries and operators that once did less than the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_text import plain_osa

from loomline import plans
from loomline.operators import integrity


def test_spelling_pairs(spark, tmp_path):
    words, terms = ["abcdefgh", "cats", "banana", "größe"], ["abcedfgh", "abcdefgh", "cat", "catz", "bananas", "bananna", "größen", "gräße", "dog"]
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, w, "de" if i % 2 else "en") for i, w in enumerate(terms)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    want = {(w, x) for w in words for x in terms if w != x and plain_osa(w, x) <= 1 and grams(w) & grams(x)}
    assert ("abcdefgh", "abcedfgh") in want
    assert {(r["word"], r["term"]) for r in plans.queries()["t17_spelling_pairs"](spark, str(tmp_path)).collect()} == want


def test_probe_sees_the_middle(spark):
    long = lambda c: "a" * 70_000 + c + "z" * 70_000
    d = spark.createDataFrame([(1, long("x")), (2, long("y")), (3, long("x"))], "key long, data string").select("key", F.lit("s").alias("sig"), F.col("data").cast("binary").alias("data"))
    assert {tuple(r) for r in integrity.probe(d, d).collect()} == {(1, 3), (3, 1)}
