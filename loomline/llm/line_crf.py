"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line that is not blank gets the state good or bad from features of its own, of the line before and of the line after (shares of byte
classes, word lengths, repeated words, repeated lines), and from the states beside it. Forward-backward gives each line's marginal; weighted
by line length they give the document's good share, from which, with the worst line and the length of bad text, a logistic layer gives the score.

Labels are for documents. Training starts from all lines of a bad document being bad, then alternates: lines of bad documents are labelled by
the model itself (one at least stays bad), lines of good ones are good, and the weights are fitted again. It uses at most MOST_TRAINING labelled
documents, those first in the order of a hash of their id; their line features are computed on the executors and the fit runs in numpy.

Defined results: null, empty or blank text is one line without words; a line of any length is one line; labels without a document or with null
are not used; where an id is labelled twice both are; without labels of both kinds every score is the only label's value (1 without any); an
empty table gives an empty result. Only id and text are read, and only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches
from loomline.llm.textkit import powers, slices, words

MOST_TRAINING = 6000
THRESHOLD = 0.7
#: Chains are cut into runs of this many lines for training only.
TRAIN_RUN = 64
ROUNDS, STEPS, RATE, RIDGE = 3, 60, 0.15, 1e-3

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"()-?", b"!", b"|<>{}[]=+_/\\", b"#$%&*@~^`"), 1):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 9
_CLASSES = 10
OWN = _CLASSES + 7
WIDTH = 3 * OWN + 3


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's rows: features of each line, its bytes, its place among the row's lines, and bounds of the rows' lines."""
    n, rows = len(data), len(off) - 1
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first[np.flatnonzero(data == 10) + 1] = True
    first = first[:n]
    start = np.flatnonzero(first)
    end = np.r_[start[1:], n] if len(start) else start
    h, at = words(data, np.r_[start, n] if len(start) else np.zeros(1, np.int64), lower=True)
    full = np.diff(at) > 0 if len(start) else np.zeros(0, bool)
    row = np.searchsorted(off, start, "right") - 1
    keep = np.flatnonzero(full)
    blank = np.setdiff1d(np.arange(rows), row[keep])  # rows without words: one line without words
    m = len(keep)
    size = (end - start)[keep].astype(float)
    count = np.diff(at)[keep].astype(float)
    total = np.zeros((m, _CLASSES))
    kinds = _CLASS[data]
    for k in range(_CLASSES):
        c = np.r_[0, np.cumsum(kinds == k)]
        total[:, k] = (c[end] - c[start])[keep]
    share = np.minimum(total / np.maximum(size, 1)[:, None] * 4, 1.0)
    # words that came before in their line, lines that came before in their row
    line = np.repeat(np.arange(len(start)), np.diff(at)) if len(start) else np.zeros(0, np.int64)
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(start))[keep] if len(start) else np.zeros(0)
    with np.errstate(over="ignore"):
        mark = np.zeros(len(start) + 1, np.uint64)
        places = np.arange(len(h)) - at[:-1][line] if len(h) else np.zeros(0, np.int64)
        np.add.at(mark, line, h * powers(np.uint64(0xA24BAED4963EE407), int(places.max()) + 1 if len(places) else 1)[places])
    mark = mark[:-1][keep]
    order = np.lexsort((mark, row[keep]))
    again = np.zeros(m)
    if m:
        again[order[1:]] = (mark[order][1:] == mark[order][:-1]) & (row[keep][order][1:] == row[keep][order][:-1])
    own = np.empty((m + len(blank), OWN))
    own[:m, :_CLASSES] = share
    own[:m, _CLASSES:] = np.stack([np.log1p(size) / 6, np.log1p(count) / 4, 1 - distinct / np.maximum(count, 1), (distinct / np.maximum(count, 1) < 0.5) * 1.0, np.minimum(size / np.maximum(count, 1) / 12, 2), again, total[:, 1] > 2 * total[:, 2]], 1)
    own[m:] = 0
    row = np.r_[row[keep], blank]
    size = np.r_[size, np.ones(len(blank))]
    order = np.argsort(row, kind="stable")
    own, row, size = own[order], row[order], size[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros((len(row), WIDTH))
    out[:, :OWN] = own
    head = np.zeros(len(row), bool)
    head[bounds[:-1]] = True
    tail = np.zeros(len(row), bool)
    tail[bounds[1:] - 1] = True
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[head, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[tail, 2 * OWN : 3 * OWN] = 0
    out[:, -3:] = np.stack([head, tail, np.ones(len(row))], 1)
    return out, size, np.arange(len(row)) - bounds[row], bounds


def marginals(unary: np.ndarray, trans: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(bad) of every line, expected transitions and the log partition of all chains, by forward-backward over all chains at once.
    unary: log odds of bad. trans[a, b]: score of b after a (0 good, 1 bad)."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], bounds[:-1][order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), "left")  # chains longer than t
    score = np.stack([np.zeros(len(unary)), unary], 1)
    a = np.zeros((len(unary), 2))
    b = np.zeros((len(unary), 2))
    norm = np.zeros(len(unary))
    e = np.exp(trans)
    for t in range(longest):
        i = begin[: live[t]] + t
        s = score[i] if t == 0 else score[i] + np.log(a[i - 1] @ e)
        top = s.max(1)
        x = np.exp(s - top[:, None])
        z = x.sum(1)
        a[i] = x / z[:, None]
        norm[i] = top + np.log(z)
    pair = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        m = live[t]
        i = begin[:m] + t
        more = live[t + 1] if t + 1 < longest else 0
        b[i[more:]] = 1
        if more:
            j = i[:more] + 1
            x = np.exp(score[j] - norm[j][:, None]) * b[j]
            b[i[:more]] = x @ e.T
            pair += (a[i[:more]].T @ x) * e
    return (a * b)[:, 1] / np.maximum((a * b).sum(1), 1e-300), pair, float(norm.sum())


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, layer: np.ndarray, constant: float | None = None):
        self.weights, self.trans, self.layer, self.constant = weights, trans, layer, constant

    def lines(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(bad) of each line."""
        return marginals(features @ self.weights, self.trans, bounds)[0]

    def documents(self, bad: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(_summary(bad, size, bounds) @ self.layer, -30, 30)))


def _summary(bad: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: log odds of the length-weighted good share, its bad length, its worst line."""
    total = np.add.reduceat(size, bounds[:-1])
    off = np.add.reduceat(bad * size, bounds[:-1])
    share = np.clip(1 - off / total, 1e-4, 1 - 1e-4)
    worst = np.maximum.reduceat(bad, bounds[:-1])
    return np.stack([np.log(share / (1 - share)), np.log1p(off) / 5, worst, np.ones(len(total))], 1)


def _fit_chain(f: np.ndarray, y: np.ndarray, bounds: np.ndarray, weights: np.ndarray, trans: np.ndarray) -> None:
    """Adam steps on the conditional likelihood, in place. y: 0 or 1 of each line."""
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    there = np.flatnonzero(inner)
    want = np.zeros((2, 2))
    np.add.at(want, (y[there - 1], y[there]), 1)
    state = [np.zeros_like(x) for x in (weights, weights, trans, trans)]
    for step in range(1, STEPS + 1):
        p, pair, _ = marginals(f @ weights, trans, bounds)
        for x, g, m, v in ((weights, f.T @ (y - p) / len(y) - RIDGE * weights, state[0], state[1]), (trans, (want - pair) / len(y) - RIDGE * trans, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def fit(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> Model:
    """features, size: of all lines; bounds: of the documents' lines; good: 0 or 1 of each document."""
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(4), float(good[0]) if len(good) else 1.0)
    doc = np.repeat(np.arange(len(good)), np.diff(bounds))
    place = np.arange(len(doc)) - bounds[doc]
    runs = np.r_[np.flatnonzero(place % TRAIN_RUN == 0), len(doc)]
    y = 1 - good[doc].astype(np.int64)
    weights, trans = np.zeros(WIDTH), np.zeros((2, 2))
    for k in range(ROUNDS):
        _fit_chain(features, y, runs, weights, trans)
        if k < ROUNDS - 1:
            own = features @ weights
            worst = np.maximum.reduceat(own, bounds[:-1])
            y = ((good[doc] == 0) & ((own > 0) | (own >= worst[doc]))).astype(np.int64)
    x = _summary(marginals(features @ weights, trans, bounds)[0], size, bounds)
    layer = np.zeros(4)
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        layer += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4), x.T @ (good - p) - 1e-2 * layer)
    return Model(weights, trans, layer)


def part_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_TRAINING) -> Model:
    """From labelled rows outside the held-out part (part_of(id, 4) = 2)."""
    bounded_batches(docs.sparkSession)
    chosen = labels.filter((part_of(id_col, 4) != 2) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "i")

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in slices(batch["text"]):
                f, size, _, bounds = line_features(data, off)
                f = f.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch["i"].slice(lo, hi - lo), batch["y"].slice(lo, hi - lo), pa.array([f[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.array([size[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["i", "y", "f", "size"]
                )

    got = rows.select("i", "y", "text").mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, y int, f binary, size binary").toArrow().sort_by([("i", "ascending"), ("y", "ascending")])
    f = np.concatenate([np.frombuffer(x, np.float32) for x in got["f"].to_pylist()] or [np.zeros(0, np.float32)]).reshape(-1, WIDTH).astype(np.float64)
    sizes = [np.frombuffer(x, np.float64) for x in got["size"].to_pylist()]
    bounds = np.r_[0, np.cumsum([len(x) for x in sizes])].astype(np.int64)
    return fit(f, np.concatenate(sizes or [np.zeros(0)]), bounds, got["y"].to_numpy())


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __score, 0 to 1."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for lo, hi, data, off in slices(text):
            f, size, _, bounds = line_features(data, off)
            out[lo:hi] = sent.value.documents(sent.value.lines(f, bounds), size, bounds)
        return pa.array(out)

    return docs.withColumn("__score", score(F.col(text_col)))


def line_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, bad): the marginal of every line that is not blank, in order."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch["text"]):
                f, _, place, bounds = line_features(data, off)
                row = np.repeat(np.arange(lo, hi), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([batch["i"].take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(sent.value.lines(f, bounds))], [id_col, "line", "bad"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, line int, bad double")
