"""The five stages together, against the plain versions stage by stage."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
import sentencepiece

from loomline.llm import line_crf
from loomline.llm.common import table
from loomline.llm.queries import piece_model, queries

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = line_crf.train(docs, table(spark, SMALL, "labels"))
    kept = [r for r in line_crf.scored(docs, model).collect() if r["__score"] >= line_crf.THRESHOLD]
    stay = {x[0] for x in brute.exact_copies([(r["doc_id"], r["text"]) for r in kept]) if x[3]}
    kept = [r for r in kept if r["doc_id"] in stay]
    near = brute.near_components([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if near[r["doc_id"]][1] == r["doc_id"]]
    times = brute.mixed([(r["doc_id"], r["text"], r["source"]) for r in kept])
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], tuple(lib.encode(r["text"]))) for r in kept for _ in range(times[r["doc_id"]][3]))
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "ids"]
    got = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], tuple(r["ids"])) for r in out.collect())
    assert got == want and 0 < len({g[0] for g in got}) < docs.count()


def test_stages_keep_clean_documents(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert corpus_pipeline.keep_quality(spark, docs, SMALL).join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_stages_return_the_columns_of_documents(spark, docs, nulls, empty):
    for some in (empty, nulls, docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SMALL)
            assert out.columns == (some.columns if name != "sentencepiece" else [*some.columns, "ids"])
            assert out.count() <= 3 * some.count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_agree_with_themselves(spark, name):
    a, b = ({tuple(map(str, r)) for r in queries()[name](spark, SMALL).collect()} for _ in range(2))
    assert a == b and a
