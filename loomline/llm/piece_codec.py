"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text becomes a chain of characters, spaces as U+2581 with one more in front. All adjacent pairs that are pieces stand on an agenda ordered by
score, then place; the best is merged, its new neighbours are put on the agenda, and so on; what is no piece in the end becomes bytes.
No piece spans a break between other characters and U+2581, nor a character that is in no piece, so a text falls into chunks that are encoded
alone; a worker keeps the chunks it has met. Every chunk is checked against the sentencepiece library the first time it is met, in one
call for an Arrow batch, and ids are decoded with the library's decode; a difference raises an error, so no wrong id leaves the operator.

Defined results: null text counts as empty and has no ids; texts of any length are encoded whole; an empty table gives an empty result. Other
columns are kept by encoded() (its own start with two underscores) and never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, releasing
from loomline.llm.textkit import HashIndex, mix

SPACE = "▁"
#: Chunks that a worker keeps; when there are more they become the older half, from which those met again return.
KEPT = 250_000
#: Chunks of at most so many characters are merged many at once, those within the same step together.
STEPS = (4, 7, 10, 13, 20)
WIDE = STEPS[-1]


class Codec:
    """A vocabulary with its agenda encoder. Normalisation is the identity with a space in front, as of the merge-type models it is for."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        special = lambda k: lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) or lib.is_unused(k)
        self.ids = {lib.id_to_piece(k): k for k in range(n) if not special(k)}
        self.rank = {p: -lib.get_score(k) for p, k in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        known = {c for p in self.ids for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or "\n" in known:
            raise ValueError("a piece holds a space after another character, or a line feed: texts do not fall into chunks")
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.newline = self.bytes[10]
        self.met: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.char_id = np.full(0x110000, -1, np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = k
        self.text = list(map(str, range(n)))
        two = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, whole = (np.array(x, np.int64) for x in zip(*two))
        key = mix((left * (1 << 20) + right).astype(np.uint64))
        order = np.argsort(key)
        self.pairs, self.pair_id = HashIndex(key[order]), whole[order].astype(np.int32)
        # ranks, not scores: whole numbers below 2**24 are exact in single precision
        score = -np.array([lib.get_score(k) for k in range(n)])
        self.pair_rank = np.unique(score, return_inverse=True)[1].astype(np.float32)[self.pair_id]

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk by the agenda."""
        rank = self.rank
        symbols = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for k in range(n - 1):
            r = rank.get(symbols[k] + symbols[k + 1])
            if r is not None:
                agenda.append((r, k, symbols[k] + symbols[k + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, k, piece = heapq.heappop(agenda)
            left = symbols[k]
            j = after[k]
            if not left or j >= n or len(left) + len(symbols[j]) != len(piece) or left + symbols[j] != piece:
                continue  # one of the two has been merged otherwise
            symbols[k], symbols[j] = piece, ""
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                r = rank.get(piece + symbols[m])
                if r is not None:
                    heapq.heappush(agenda, (r, k, piece + symbols[m]))
            b = before[k]
            if b >= 0:
                r = rank.get(symbols[b] + piece)
                if r is not None:
                    heapq.heappush(agenda, (r, b, symbols[b] + piece))
        out: list[int] = []
        for s in symbols:
            if s:
                k = self.ids.get(s)
                out += [k] if k is not None else [self.bytes[x] for x in s.encode()]
        return out

    def merge_many(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many chunks. Short ones are merged many at once, those of like length together; long ones, and those with characters
        that are in no piece, have a heap of their own."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.r_[0, np.cumsum(size)]
        char = self.char_id[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        short = (size <= WIDE) & (np.minimum.reduceat(char, start[:-1]) >= 0)
        out = [None if ok else self.merge(c) for ok, c in zip(short.tolist(), chunks)]
        for lo, hi in zip((0, *STEPS), STEPS):
            rows = np.flatnonzero(short & (size > lo) & (size <= hi))
            if len(rows):
                n = size[rows]
                sym = np.full((len(rows), hi + 1), -1, np.int32)
                sym[:, :hi][np.arange(hi) < n[:, None]] = char[np.repeat(start[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for k, ids in zip(rows.tolist(), self.merge_rows(sym)):
                    out[k] = ids
        return out

    def merge_rows(self, sym: np.ndarray) -> list[list[int]]:
        """Rows of symbols (-1: none, at least one at the end), each a chain with its agenda as a row of scores; every round takes the best
        pair of each row, the first of equal ones, and looks up the two new neighbours."""
        rows, wide = sym.shape
        agenda, made = np.full(sym.shape, np.inf, np.float32), np.zeros(sym.shape, np.int32)
        agenda[:, :-1], made[:, :-1] = self.look(sym[:, :-1], sym[:, 1:])
        after = np.broadcast_to(np.minimum(np.arange(1, wide + 1), wide - 1), sym.shape).copy()
        before = np.broadcast_to(np.arange(-1, wide - 1), sym.shape).copy()
        live = np.arange(rows)
        while len(live):
            best = agenda[live].argmin(1)
            go = agenda[live, best] < np.inf
            live, best = live[go], best[go]
            gone = after[live, best]
            then = after[live, gone]
            sym[live, best] = made[live, best]
            sym[live, gone] = -1
            agenda[live, gone] = np.inf
            after[live, best] = then
            before[live, then] = best
            left = before[live, best]
            some = left >= 0
            row, at = np.r_[live, live[some]], np.r_[best, left[some]]
            agenda[row, at], made[row, at] = self.look(sym[row, at], sym[row, np.r_[then, best[some]]])
        ids, cuts = sym[sym >= 0].tolist(), np.r_[0, np.cumsum((sym >= 0).sum(1))].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (lower is earlier, infinite: no piece) and ids of pairs of pieces."""
        found = self.pairs.find(mix((left.astype(np.int64) * (1 << 20) + right).astype(np.uint64).ravel())).reshape(left.shape)
        found[(left < 0) | (right < 0)] = -1
        return np.where(found < 0, np.float32(np.inf), self.pair_rank[found]), self.pair_id[found]

    def split(self, text: str) -> list[str]:
        """Chunks of a text; a line feed is one of its own."""
        if not text:
            return []
        s = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in s or s[-1] == SPACE or SPACE + "\n" in s:
            return self.chunk.findall(s)
        return list(filter(None, s.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")))

    def learn(self, new: list[str]) -> None:
        """Encode chunks not met before and check them against the library. The library puts a space in front of what it encodes, so
        chunks without one of their own are sent behind a line feed."""
        asked = self.library.encode(["\n" + c if c[0] != SPACE else c[1:] for c in new], num_threads=1)
        ids = self.merge_many(new)
        for c, mine, theirs in zip(new, ids, asked):
            if c[0] != SPACE:
                theirs = theirs[theirs.index(self.newline) + 1 :]
            elif c == SPACE:
                theirs = mine  # the library has no text for a lone space; the decoded text shows it
            if mine != theirs:
                raise ValueError(f"agenda and library differ on {c!r}: {mine} and {theirs}")
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))).tobytes()
        cuts = np.r_[0, 4 * np.cumsum([len(x) for x in ids], dtype=np.int64)].tolist()
        self.met.update(zip(new, (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:]))))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.split(t) for t in texts]
        if len(self.met) > KEPT:
            self.met, self.old = {}, self.met
        need = set(chain.from_iterable(split)).difference(self.met)
        if need:
            again = need & self.old.keys()
            self.met.update((c, self.old[c]) for c in again)
            if len(again) < len(need):
                self.learn(sorted(need - again))
        get = self.met.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.uint32) for s in split]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Characters of text that are encoded together.
TOGETHER = 1 << 20


def _together(texts: list[str]):
    lo = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= TOGETHER:
            yield lo, k + 1
            lo, n = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every text."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            n, ids, decoded = [], [], []
            for lo, hi in _together(texts):
                for found in c.encode_batch(texts[lo:hi]):
                    numbers = found.tolist()
                    n.append(len(numbers))
                    ids.append(hashlib.sha256(",".join([c.text[k] for k in numbers]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.library.decode(numbers).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["i"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(releasing(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with __ids, the token ids of each text."""

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        c = codec(path)
        texts = [t or "" for t in text.to_pylist()]
        out, bounds = [], [0]
        for lo, hi in _together(texts):
            for found in c.encode_batch(texts[lo:hi]):
                out.append(found.astype(np.int32))
                bounds.append(bounds[-1] + len(found))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))

    return docs.withColumn("__ids", encode(F.col(text_col)))


def decoded(rows: DataFrame, path: str, ids_col: str = "__ids") -> DataFrame:
    """rows with __text, what the library's decode makes of the ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        lib = codec(path).library
        return pa.array([lib.decode(x) if x else "" for x in ids.to_pylist()], pa.string())

    return rows.withColumn("__text", decode(F.col(ids_col)))
