from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"
CLASHING = "k long, i string, n string, c string, d string, h string, r string, src string, size string, u string, root string, best string, w string"


def made(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): fresh texts, copies in another case, near copies, shared passages, very short and empty ones, null."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["ÄRger", "naïve", "Größe", "x y", "日本語", "A.B", "—"]
    text = lambda m: " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(m))
    passage = " ".join(rng.choice(words) for _ in range(80))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = text(rng.randint(20, 120))
        elif kind == 1:
            t = rng.choice([x[1] for x in out if x[1]]).upper()
        elif kind == 2:
            w = rng.choice([x[1] for x in out if x[1]]).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind == 3:
            t = text(15) + " " + passage[rng.randrange(60) :] + "\t" + text(10)
        elif kind == 4:
            t = rng.choice(["", None, " \n ", "one", "One  two", "a b c d", "a b c d e"])
        else:
            t = text(6) + " " + " ".join(["again and"] * rng.randint(2, 60))
        out.append((1000 - 7 * i, t, rng.choice(["web", "web", "web", "books", "", None])))
    out.append((5, "long " + text(6000), "web"))
    return out


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows in several partitions, with nulls and with further columns whose names operators might use themselves."""
    extra = (1, "x", None, "x", None, "x", "x", None, "1", "x", "x", None, "x")
    df = spark.createDataFrame([(i, t, None, s, None, *extra) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def nulls(spark, docs):
    """Every column null, once and again."""
    return spark.createDataFrame([(None,) * len(docs.columns)] * 3, docs.schema)
