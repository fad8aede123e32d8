"""Tokeniser fertility against a plain count of every word's tokens, and bands against sorted values."""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from loomline.llm import fertility, queries

SMALL = "/root/testdata/sf0.001"
PATHS = (queries.piece_model(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def encoders():
    with open(PATHS[1], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return sentencepiece.SentencePieceProcessor(model_file=PATHS[0]), tiktoken.Encoding("pairs", pat_str=PATHS[2], mergeable_ranks=ranks, special_tokens={})


def plain_measures(text: str | None, encoders) -> tuple:
    sp, pairs = encoders
    ids, n = [], 0
    words = WORD.findall(text or "")
    for w in words:
        raw = w.encode()
        for k in range(0, len(raw), fertility.LONG):
            part = raw[k : k + fertility.LONG].decode("utf-8", "replace")
            ids += sp.encode(part)
            n += len(pairs.encode_ordinary(" " * (k == 0) + part))
    chars = sum(map(len, words))
    share = [c / len(ids) for c in Counter(ids).values()]
    return chars / max(1, len(ids)), chars / max(1, n), sum(map(sp.is_byte, ids)) / max(1, len(ids)), -sum(x * math.log2(x) for x in share)


def texts(rows) -> list[tuple]:
    odd = ["a\n\na\n a\na\r\na\n \n\t\nb", "x " * 4000, "é" * 3000 + " ok", "中文" * 40 + "\n" + "Пр " * 30, "\x00\x01 ▁ <s> </s> <0x0A>", "|".join("ab") * 50, "one two three four five " * 2, "    힣\U0001f600 " * 7]
    return [(i, t, random.Random(i).choice(["en", "en", None, " "])) for i, t, _ in rows] + [(-k - 1, t, "xx") for k, t in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2, None, "k") for i, t, g in rows], "doc_id long, text string, lang string, n long, script string, len int, key string, id string").repartition(4)


def test_counts_and_measures_equal_plain_ones(spark, rows, encoders):
    every = texts(rows)
    out = {r["doc_id"]: r for r in fertility.judged(frame(spark, every), *PATHS).collect()}
    assert len(out) == len(every)
    for i, t, _ in every:
        r = out[i]
        want = plain_rules(t)
        assert tuple(r[c] for c in fertility.COUNTS) == want, (i, t)
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"]) and r["band"] is None  # too few texts for any band
        for m, x in zip(fertility.MEASURES, plain_measures(t, encoders)):
            assert math.isclose(r[m], x, rel_tol=1e-9, abs_tol=1e-9), (i, m)


def test_scripts(spark):
    rows = [(0, "abc def", None), (1, "中文中 a", None), (2, "При a", None), (3, "12 34", None), (4, None, None), (5, "नमस् a", None)]
    assert [r["script"] for r in fertility.judged(frame(spark, rows), *PATHS).orderBy("doc_id").collect()] == ["latin", "han", "cyrillic", "other", "other", "indic"]


def words(rng, n: int, kind: str) -> str:
    stems = ["water", "house", "the", "of", "running", "people", "after", "little", "country", "and", "morning", "light"]
    if kind == "noise":
        return " ".join("".join(rng.choice("xqzjkv#*%") for _ in range(7)) for _ in range(n))
    return " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def many():
    """Two languages of a script, of which the smaller has no band of its own, and noise among both."""
    rng = random.Random(4)
    return [(k, words(rng, 40, "noise" if k % 25 == 0 else "prose"), "aa" if k % 5 else "bb") for k in range(900)]


def test_bands_equal_sorted_values(spark, many, encoders):
    out = fertility.judged(frame(spark, many), *PATHS).collect()
    values, whole = defaultdict(list), {}
    for i, t, g in many:
        r = plain_rules(t)
        if r[0] >= 10 and 100 * r[4] <= 20 * r[0]:
            whole[i] = plain_measures(t, encoders)
            for key in (f"latin/{g}", "latin"):
                values[key].append(whole[i])
    assert len(values["latin/aa"]) >= fertility.LEAST > len(values["latin/bb"])

    def inside(x, group) -> bool:
        for k, (width, _, share, least, low, high) in enumerate(fertility.MEASURES.values()):
            bins = sorted(math.floor(v[k] / width) for v in group)
            q1, q2, q3 = (bins[math.ceil(q * len(bins)) - 1] for q in (0.25, 0.5, 0.75))
            middle = (q2 + 0.5) * width
            spread = lambda d: max(d * width / 0.6745, share * middle, least)  # noqa: E731, B023
            if (low and x[k] < middle - fertility.LOW * spread(q2 - q1)) or (high and x[k] > middle + fertility.HIGH * spread(q3 - q2)):
                return False
        return True

    for r in out:
        key = "latin/aa" if r["doc_id"] % 5 else "latin"
        assert r["band"] == key
        assert r["kept"] == (r["doc_id"] in whole and inside(whole[r["doc_id"]], values[key])), r
    noise = [r["kept"] for r in out if r["doc_id"] % 25 == 0]
    prose = [r["kept"] for r in out if r["doc_id"] % 25]
    assert not any(noise) and sum(prose) > 0.98 * len(prose)


def test_more_bands_than_are_broadcast(spark, many, monkeypatch):
    want = sorted(map(tuple, fertility.judged(frame(spark, many), *PATHS).select("doc_id", "kept", "band").collect()))
    monkeypatch.setattr(fertility, "MAX_BROADCAST_BANDS", 0)
    assert sorted(map(tuple, fertility.judged(frame(spark, many), *PATHS).select("doc_id", "kept", "band").collect())) == want


def test_repeats_do_not_depend_on_batches(spark, rows):
    every = texts(rows)
    both = frame(spark, every + every)
    lines = [tuple(r) for r in fertility.measured(both, *PATHS).collect()]
    assert len(lines) == 2 * len(every) and len(set(lines)) == len(every)


def test_empty_and_null_tables(spark, empty, nulls):
    assert fertility.judged(empty, *PATHS).collect() == []
    assert {(r["n_words"], r["base_failed"], r["kept"]) for r in fertility.judged(nulls, *PATHS).collect()} == {(0, True, False)}


def test_words_kept_by_a_worker_are_bounded(monkeypatch):
    known = fertility.Vocabularies(*PATHS)
    monkeypatch.setattr(fertility, "KEPT_WORDS", 3)
    import numpy as np
    import pyarrow as pa

    from loomline.llm import textkit

    seen = []
    for text in ("a b c d e", "a b x", "a b c d e"):
        for _, _, data, off in textkit.slices(pa.array([text])):
            h, bounds = textkit.words(data, off, lower=False)
            seen.append([float(x[0]) for x in fertility.tokens(data, off, h, bounds, known)])
    assert seen[0] == seen[2] and len(known.at) <= 8 and np.all(np.diff(known.cuts) > 0)


def test_query_holds_clean_documents(spark):
    rows = queries.op11_fertility(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    good = {r[0] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    verdicts = [r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(verdicts) >= 0.97 * len(verdicts)
