"""Katz back-off scores, the line classifier, SentencePiece, and the search index."""

from __future__ import annotations

import hashlib
import itertools
import math

import brute
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomline.llm import katz, line_crf, piece_codec, posting_ann
from loomline.llm.queries import piece_model

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def test_katz_equals_brute_force(docs, rows):
    model = brute.Katz([t for i, t, _ in rows if brute.part(i, 10)])
    got = {r["doc_id"]: r for r in katz.scored(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n, known, base, score = model.score(t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (brute.part(i, 10) == 0, n, known, model.n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9), (i, r["score"], score)


def test_brute_katz_is_normalised(rows):
    model = brute.Katz([t for _, t, _ in rows])
    for h in ["<s>", "w1", "again", "never seen"]:
        assert math.isclose(sum(model.prob(h, w) for w in [*model.uni, None]), 1, rel_tol=1e-9)


@pytest.mark.parametrize("size", [0, 1, 20])
def test_katz_does_not_depend_on_the_vocabulary(docs, rows, size):
    """However few words are broadcast, every word keeps its own counts and pairs."""
    model = brute.Katz([t for i, t, _ in rows if brute.part(i, 10)])
    assert model.v > 20
    got = {r["doc_id"]: r for r in katz.scored(docs, vocabulary_size=size).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n, known, base, score = model.score(t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, model.n)
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9) and math.isclose(got[i]["score"], score, rel_tol=1e-9), (i, got[i]["score"], score)


def test_katz_of_real_texts_does_not_depend_on_the_vocabulary(spark):
    """Rows that repeat, texts with unknown words and contexts, against brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = brute.Katz([t for i, t in rows if brute.part(i, 10)])
    want = {i: model.score(t) for i, t in rows}
    for size in (katz.VOCABULARY, 500):
        got = katz.scored(docs, vocabulary_size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, base, score = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"]) == (n, known)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_katz_edges(docs, nulls, empty):
    assert katz.scored(empty).count() == 0
    got = katz.scored(nulls).collect()
    assert {(r["held_out"], r["n_tokens"], r["train_tokens"]) for r in got} == {(brute.part("", 10) == 0, 1, 0 if brute.part("", 10) == 0 else 3)}
    assert katz.scored(docs.unionByName(docs)).count() == 2 * docs.count()


def test_katz_keeps_ids_as_they_are(spark):
    rows = [(2**53 + 1, "a b c"), (None, "a b"), (2**53 + 3, "c")]
    assert {r["doc_id"] for r in katz.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()} == {x[0] for x in rows}
    names = spark.createDataFrame([("x-1", "a b"), (None, "c d"), ("7", None)], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in katz.scored(names).collect()) == ["7", "None", "x-1"]


def test_katz_beats_the_base_on_held_out_text(spark):
    got = katz.scored(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    trans, unary, bounds = rng.normal(size=(2, 2)), rng.normal(size=9), np.array([0, 1, 4, 9])
    bad, _, log_z = line_crf.marginals(unary, trans, bounds)
    want = 0.0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        z, mass = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            e = math.exp(sum(u for u, s in zip(unary[lo:hi], y) if s) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += e
            mass += e * np.array(y)
        want += math.log(z)
        assert np.allclose(bad[lo:hi], mass / z)
    assert math.isclose(log_z, want)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{n}.parquet") for n in ("documents", "labels"))
    model = line_crf.train(docs, labels)
    got = line_crf.scored(docs.filter(line_crf.part_of("doc_id", 4) == 2), model).join(labels, "doc_id").select("__score", "quality").collect()
    good, bad = ([r[0] for r in got if r[1] == y] for y in (1, 0))
    assert all(0 <= r[0] <= 1 for r in got)
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert np.mean([s >= line_crf.THRESHOLD for s in good]) > 0.9


def test_scores_do_not_depend_on_batches_or_neighbours(spark, docs):
    model = line_crf.train(spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet"))
    key = lambda df: {r["doc_id"]: r["__score"] for r in line_crf.scored(df, model).collect()}
    a, b = key(docs), key(docs.coalesce(1).orderBy("text"))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_quality_edges(spark, docs, nulls, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__score"] for r in line_crf.scored(docs, line_crf.train(docs, none)).collect()} == {1.0}
    odd = spark.createDataFrame([(None, 1, 0), (1000, None, 0), (987654, 0, 0)], "doc_id long, quality int, toxic int")
    model = line_crf.train(docs, odd)
    assert line_crf.scored(empty, model).count() == 0
    real = line_crf.train(spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet"))
    got = line_crf.scored(nulls, real)
    assert got.columns == [*nulls.columns, "__score"] and all(0 <= r["__score"] <= 1 for r in got.collect())
    lines = line_crf.line_labels(spark.createDataFrame([(1, "a b\n\nc d"), (2, None)], "doc_id long, text string"), real).collect()
    assert sorted((r["doc_id"], r["line"]) for r in lines) == [(1, 0), (1, 1), (2, 0)]


HARD = ["", " ", "  two  spaces ", "\n", "a\nb\n\n", " \n ", "tab\there", "▁", "▁▁x ▁", "ünïcödé 日本語 🙂👩‍👩‍👧", "x y z", "\u0000\u0001", "<s> </s> <unk> <0x41>", "a" * 700, "ab " * 300, " lead", "trail ", "\r\n", "é é", "ﬁ ½ Ⅷ", "1234567890", "﻿bom", "؟ العربية हिन्दी"]


def test_ids_equal_the_library(spark, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = HARD + [t or "" for _, t, _ in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in piece_codec.digests(df, piece_model()).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids))), t
    back = piece_codec.decoded(piece_codec.encoded(df, piece_model()), piece_model()).collect()
    assert all(r["__ids"] == lib.encode(r["text"]) and r["__text"] == lib.decode(lib.encode(r["text"])) for r in back)


def test_agenda_alone_equals_the_library():
    c, lib = piece_codec.codec(piece_model()), sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = np.random.default_rng(2)
    for _ in range(300):
        t = "".join(rng.choice(list("aeinrst hlo\nüß—"), rng.integers(1, 40)))
        assert list(itertools.chain.from_iterable(c.merge(x) for x in c.split(t))) == lib.encode(t), t


def test_codec_edges(docs, nulls, empty):
    assert piece_codec.digests(empty, piece_model()).count() == 0 and piece_codec.encoded(empty, piece_model()).count() == 0
    assert {tuple(r) for r in piece_codec.digests(nulls, piece_model()).collect()} == {(None, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())}
    assert piece_codec.encoded(docs, piece_model()).columns == [*docs.columns, "__ids"]


def exact(vectors: list, queries, k: int = 20) -> dict:
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for i in queries:
        s = x @ x[np.flatnonzero(ids == i)[0]]
        order = sorted((-s[j], int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:k]
        out[i] = [j for _, j in order]
    return out


def test_recall(spark):
    df = spark.read.parquet(f"{MID}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(vectors, [i for i, _ in vectors if i % 20 == 0])
    got = posting_ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert np.mean([(q, v) in found for q, near in want.items() for v in near]) >= 0.95
    by_id = dict(vectors)
    for r in got[:200]:
        assert math.isclose(r["score"], float(np.dot(np.float64(by_id[r["query_id"]]), np.float64(by_id[r["vec_id"]]))), rel_tol=1e-12)
    for q in want:
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_search_edges(spark):
    kind = "vec_id long, embedding array<float>, id string, q string, list int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0]), (40, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (60, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, None, "x", 1) for i, v in rows], kind)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in posting_ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (0, 4, 3, -1.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 3, -1.0)]
    for none in (df.limit(0), df.filter("vec_id = 40")):
        assert posting_ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seed", [3])
def test_search_with_a_hot_vector(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 8))
    x[::3] = x[0]
    vectors = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    got = posting_ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 20 == 0).collect()
    score = {q: sorted((r["score"] for r in got if r["query_id"] == q), reverse=True) for q in range(0, 600, 20)}
    m = np.array([v for _, v in vectors])
    for q, s in score.items():
        assert len(s) == 20 and np.allclose(s, np.sort(np.delete(m @ m[q], q))[::-1][:20], rtol=0.15)


def test_recall_where_lists_are_many(spark, monkeypatch):
    """With lists far more than LISTS and no clusters to speak of, more lists are read until recall holds."""
    monkeypatch.setattr(posting_ann, "LIST", 6)
    x = np.random.default_rng(5).normal(size=(6000, 24)).astype(np.float32)
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = posting_ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 20 == 0).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert np.mean([(q, v) in found for q, near in exact(vectors, range(0, 6000, 20)).items() for v in near]) >= 0.9


@pytest.mark.parametrize("second", [0.0, 1.0])
def test_search_with_repeated_rows(spark, second):
    """Thirty rows of one id, equal or equal in score alone, are one candidate and displace nobody."""
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, second * j]) for j in range(30)] + [(i, [5.0 - i / 100, 0.0]) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r["rank"], r["vec_id"]) for r in posting_ann.nearest(df, F.col("vec_id") == 0).collect())
    assert got == [(k, k) for k in range(1, 21)]


def test_search_of_queries_that_are_centroids(spark):
    """A few vectors far from all others get lists of their own; their queries still find as many as asked for."""
    x = np.random.default_rng(6).normal(size=(3000, 8)).astype(np.float32)
    x[::100] = x[::100] * 1e-3 + np.eye(8, dtype=np.float32)[np.arange(30) % 8] * 40
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = posting_ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {20} and got.count() == 150 * 20
