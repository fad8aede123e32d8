"""Canonical texts and signatures on the JVM against json.dumps of a document cleaned by hand."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from loomline.operators import canonical


def dumps(x) -> str:
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def texts(spark, values: list) -> list[str]:
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "doc long, raw string")
    out = canonical.texts(rows.select("doc", F.lit("p").alias("part"), F.parse_json("raw").alias("v")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return [r["text"] for r in out.orderBy("doc").collect()]


CASES = [
    (None, None), (True, True), (7, 7), (-12345678901234567890, -12345678901234567890), (1.5, 1.5), (1.0, 1.0), (0.25, 0.25), ("", ""), ([], []), ({}, {}),
    (" a \n  b\u0085 ", "a b"), ('q"\\ \x01\x1b\x7f é日\U0001f600', 'q"\\ \x01\x1b\x7f é日\U0001f600'),
    ({"b": 1, "a": [1, {"d": None, "c": " x "}], "é": 2, "B": 3}, {"b": 1, "a": [1, {"d": None, "c": "x"}], "é": 2, "B": 3}),
    ({"likes": 3, "x": {"counters": 1, "y": [[], [[]], {}]}, "hash": [1]}, {"x": {"y": [[], [[]], {}]}}),
    ({"uuid": "u  1", "w": 3}, {"uuid": "u  1"}), ({"uuid": "", "w": 3}, {"uuid": "", "w": 3}), ({"uuid": 5, "w": 3}, {"uuid": 5, "w": 3}),
    ([{"type": "osnovaEmbed", "data": {"original_id": 55, "z": 1}}, {"original_id": "o", "k": 1}, {"original_id": 0, "data": {"original_id": 9}}, {"type": "osnovaEmbed", "k": 1}], [{"embed": 55}, {"embed": "o"}, {"embed": 9}, {"type": "osnovaEmbed", "k": 1}]),
    ([{"k": k} for k in range(120)], [{"k": k} for k in range(120)]),
]


def test_texts_of_cases(spark):
    assert texts(spark, [x for x, _ in CASES]) == [dumps(y) for _, y in CASES]
    assert [canonical.plain_text(x) for x, _ in CASES] == [dumps(y) for _, y in CASES]


def test_texts_of_random_documents(spark):
    rng = random.Random(5)

    def value(depth: int):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return rng.choice([None, True, rng.randrange(-99, 99), "  s p ", "", "é\n", 'a"b'])
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "c c", "likes", "uuid", "type", "data", "original_id", "Z"]): value(depth - 1) for _ in range(rng.randrange(5))}

    values = [value(6) for _ in range(300)]
    assert texts(spark, values) == [canonical.plain_text(v) for v in values]


def test_a_deep_document(spark):
    deep = "x"
    for k in range(90):
        deep = [deep] if k % 2 else {"k": deep}
    assert texts(spark, [deep]) == [dumps(deep)]


def test_signatures(spark):
    docs = [{"text": "hi  there", "media": [{"uuid": "u", "w": 1}], "likes": 2}, {"text": None, "media": None}, {}, {"text": "", "media": [], "x": 1}]
    raw = [json.dumps(d) for d in docs] + ["no json", "[1]", "null", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "id long, raw string")
    got = {r["id"]: r["sig"] for r in canonical.signed(rows, "id", "comment").collect()}
    one = hashlib.sha1(b'{"media":[{"uuid":"u"}],"text":"hi there"}').hexdigest()[:16]
    none = hashlib.sha1(b'{"media":[],"text":""}').hexdigest()[:16]
    assert got == {0: one, 1: none, 2: none, 3: none, 4: None, 5: None, 6: None, 7: None}
    assert [canonical.plain_signature("comment", d) for d in docs] == [one, none, none, none]
    posts = [{"title": "T", "blocks": [{"type": "text", "data": {"text": " a"}}], "customCover": {"uuid": "c", "x": 1}, "repostId": 5}, {"repostId": 0, "repostData": {"data": {"id": 9}}, "title": None}, {"blocks": None}]
    want = ['{"blocks":[{"data":{"text":"a"},"type":"text"}],"customCover":{"uuid":"c"},"repost":5,"title":"T"}', '{"blocks":[],"customCover":null,"repost":9,"title":""}', '{"blocks":[],"customCover":null,"repost":null,"title":""}']
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(posts)], "id long, raw string")
    assert [r["sig"] for r in canonical.signed(rows, "id", "post").orderBy("id").collect()] == [hashlib.sha1(w.encode()).hexdigest()[:16] for w in want]
    assert [canonical.plain_signature("post", p) for p in posts] == [hashlib.sha1(w.encode()).hexdigest()[:16] for w in want]
