"""Scoring by a Katz back-off model whose counts are discounted by Good-Turing.

Tokens are words with A-Z lower-cased and an end; each document starts from a context of its own. The model has two levels:

  p(w | h) = d(c) c(h, w) / c(h) if the pair was seen, else a(h) p(w);  p(w) = d(c) c(w) / N, and what is left for unseen words together.

d(r) is Katz's discount up to TOP occurrences, 1 above; where counts of counts give none in (0, 1], it is (r - 0.5) / r. a(h) is exactly what the
discounts leave, divided by the probability of the words not seen after h. A context whose counts leave nothing gets one more count in its
denominator, and one after which every word was seen is not discounted, so every distribution sums to 1.

Every word of every document has its own counts, at any size. How pairs travel depends on their words alone, never what they count: pairs of two
frequent words (a vocabulary of at most VOCABULARY words, a broadcast of at most 2**20 lines) have keys of 42 bits and go packed; pairs that hold
another word are rows keyed by the words' 64-bit hashes, counted, given the probability of their word and the weight of their context by joins.
The scores are the same for any vocabulary_size.

Tables: word counts and pair counts, partitioned by bucket, pair counts that hold a rarer word, and the contexts that are rarer words. Pairs are
dealt by the hash of context and word together, so a frequent context is spread over all tasks, and a packed pair is sent once for each flush of a
task. Scoring sends pairs to the bucket that holds their count.

Defined results: null or empty text is one token, the end; a null id counts as the empty text in the split (held out); rows equal in id and
text are scored alike; words not seen in training share what is left as one class; without training rows N is 0, no word is known, and base and score are
log10(1) a token; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, releasing, row_key, stored
from loomline.llm.exchange import binary, bucket_of, buckets_for, by_bucket, text_bytes, unpack
from loomline.llm.textkit import HashIndex, mix, slices, words

VOCABULARY = 1 << 20
TOP = 5
FLUSH = 1 << 19
#: A pair's key is context << SHIFT | word.
SHIFT = np.uint64(21)
#: In place of a word's hash: the end, and the context before the first word.
END, START = np.uint64(2**64 - 1), np.uint64(2**64 - 2)
#: Counts from here on are one line in the table of counts of counts.
MANY = 100_000


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """d(0) .. d(TOP), d(0) unused."""
    n = [counts_of_counts.get(r, 0) for r in range(TOP + 2)]
    out = np.ones(TOP + 1)
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= TOP, d[np.minimum(c, TOP)], 1.0)


def _flushes(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(columns of the rows, their word hashes, bounds) for runs of about FLUSH words."""
    have, n = [], 0

    def joined():
        cols = [pa.concat_arrays(x) for x in zip(*[c for c, _, _ in have])]
        h = np.concatenate([x for _, x, _ in have])
        sizes = np.concatenate([np.diff(b) for _, _, b in have])
        return cols, h, np.r_[0, np.cumsum(sizes)]

    for batch in batches:
        for lo, hi, data, off in slices(batch["text"]):
            h, bounds = words(data, off, lower=True)
            have.append(([batch[c].slice(lo, hi - lo) for c in columns], h, bounds))
            n += len(h) + hi - lo
            if n >= FLUSH:
                yield joined()
                have, n = [], 0
    if have:
        yield joined()


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, values, len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """(w, c, bucket) of all words of the texts, ends aside."""

    def local(batches):
        for _, h, _ in _flushes(batches, []):
            w, c = np.unique(h, return_counts=True)
            at, cuts, (w, c) = by_bucket(bucket_of(w, buckets), w, c)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), binary(w, cuts), binary(c.astype(np.int64), cuts)], ["bucket", "ws", "cs"])

    def merge(group: pa.Table) -> pa.Table:
        w, c = _sum_by(unpack(group["ws"], np.uint64), unpack(group["cs"], np.int64))
        return pa.table({"w": w.view(np.int64), "c": c, "bucket": np.full(len(w), group["bucket"][0].as_py(), np.int32)})

    return train.select("text").mapInArrow(releasing(local), "bucket int, ws binary, cs binary").groupBy("bucket").applyInArrow(merge, "w long, c long, bucket int")


def chained(tokens: np.ndarray, bounds: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row) of all pairs of the rows; a row of n words has n + 1."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    token = np.full(len(row), end, np.uint64)
    inner = np.ones(len(row), bool)
    inner[last] = False
    token[inner] = tokens
    before = np.empty(len(row), np.uint64)
    before[1:] = token[:-1]
    before[last - n] = start
    return before, token, row


class Vocabulary:
    """Frequent words by id in order of their hash; then the end, all other words, and the start (a context only). tally has the number of words
    and of tokens for each count (MANY: that or more), the end aside."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, tally: dict[int, tuple[int, int]], docs: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.least, self.docs = hashes[order], counts[order], least, docs
        self.end, self.other, self.start = len(hashes), len(hashes) + 1, len(hashes) + 2
        n_of = {c: n for c, (n, _) in tally.items()}
        if docs:
            n_of[min(docs, MANY)] = n_of.get(min(docs, MANY), 0) + 1
        self.n, self.v = docs + sum(t for _, t in tally.values()), sum(n_of.values())
        self.d = d = discounts(n_of)
        mass = sum(t if c > TOP else c * n * d[c] for c, (n, t) in tally.items()) + float(discounted(np.array([docs]), d)[0])
        self.total = float(self.n) if mass < self.n - 1e-9 else self.n + 1.0
        self.unseen = max(1.0 - mass / self.total, 0.0)
        end = discounted(np.array([docs]), d) / self.total if docs else self.unseen
        self.p = np.r_[discounted(self.counts, d) / self.total, end, 0.0, 0.0]
        self.base = self.base_of(np.r_[self.counts, docs])

    def base_of(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def index(self) -> HashIndex:
        if not hasattr(self, "_index"):
            self._index = HashIndex(self.hashes)
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def ids(self, h: np.ndarray) -> np.ndarray:
        found = self.index().find(h)
        return np.where(found < 0, self.other, found)

    def of_hashes(self, h: np.ndarray) -> np.ndarray:
        """Ids where END and START may stand among the hashes."""
        return np.where(h == END, self.end, np.where(h == START, self.start, self.ids(h)))

    def probability(self, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
        """p(w); c is the count of words outside the vocabulary, 0 if they were not seen."""
        rare = np.where(c > 0, discounted(c, self.d) / self.total, self.unseen)
        return np.where(ids == self.other, rare, self.p[ids])

    def pairs(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all pairs within the vocabulary, and the row of each."""
        before, token, row = chained(self.ids(h), bounds, self.start, self.end)
        ok = (before != self.other) & (token != self.other)
        return before[ok] << SHIFT | token[ok], row[ok]


def vocabulary(counts: DataFrame, docs: int, most: int) -> Vocabulary:
    """From the table of word counts; at most so many words, those of the highest counts."""
    grouped = counts.groupBy(F.least("c", F.lit(MANY)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).orderBy(F.desc("c")).collect()  # MANY lines at most
    total, least = 0, 1
    for r in grouped:
        total += int(r["n"])
        if total > most:
            least = int(r["c"]) + 1
            break
    if least > MANY:  # so many words occur MANY times that they are told apart by their exact counts
        top = [int(r["c"]) for r in counts.filter(F.col("c") >= MANY).orderBy(F.desc("c")).select("c").limit(most + 1).collect()]
        least = top[-1] + 1
    kept = counts.filter(F.col("c") >= least).select("w", "c").toArrow()
    return Vocabulary(kept["w"].to_numpy().view(np.uint64), kept["c"].to_numpy(), least, {int(r["c"]): (int(r["n"]), int(r["t"])) for r in grouped}, docs)


def _deltas(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)).tobytes())


def _keys(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unzip(packed), np.uint64), dtype=np.uint64)


def pair_counts(train: DataFrame, vocab, buckets: int) -> DataFrame:
    """(bucket, keys, counts): of each bucket of pairs, the sorted keys (as packed differences) and how often they occur."""

    def local(batches):
        for _, h, bounds in _flushes(batches, []):
            key, c = np.unique(vocab.value.pairs(h, bounds)[0], return_counts=True)
            at, cuts, (key, c) = by_bucket(bucket_of(mix(key), buckets), key, c)
            packed = [_deltas(key[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            tallies = [_zip(c[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary()), pa.array(tallies, pa.binary())], ["bucket", "keys", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        keys = np.concatenate([_keys(x) for x in group["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(_unzip(x), np.int32) for x in group["counts"].to_pylist()])
        key, c = _sum_by(keys, counts)
        return pa.table({"bucket": [group["bucket"][0].as_py()], "keys": [_deltas(key)], "counts": [_zip(c.tobytes())]}, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    rows = train.select("text").mapInArrow(releasing(local), "bucket int, keys binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, counts binary")


def rare_pairs(looked: DataFrame, sent) -> DataFrame:
    """(j, h, w, times, rare_h, rare_w) of the pairs that hold a word outside the vocabulary, one row for each document and pair."""

    def spread(batches):
        v = sent.value
        for batch in batches:
            each = [np.frombuffer(x, np.uint64) for x in batch["rare"].to_pylist()]
            if not each:
                continue
            pairs = np.concatenate(each).reshape(-1, 2)
            row = np.repeat(np.arange(len(each)), [len(x) // 2 for x in each])
            order = np.lexsort((pairs[:, 1], pairs[:, 0], row))
            h, w, row = pairs[order, 0], pairs[order, 1], row[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (row[1:] != row[:-1])])
            times = np.diff(np.r_[first, len(h)])
            h, w, j = h[first], w[first], batch["j"].to_numpy()[row[first]]
            rare_h, rare_w = v.of_hashes(h) == v.other, v.of_hashes(w) == v.other
            for lo in range(0, len(h), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (j, h.view(np.int64), w.view(np.int64), times, rare_h, rare_w)], ["j", "h", "w", "times", "rare_h", "rare_w"])

    return looked.filter("octet_length(rare) > 0").select("j", "rare").mapInArrow(releasing(spread), "j long, h long, w long, times long, rare_h boolean, rare_w boolean")


def counted_words(rows: DataFrame, rarer: DataFrame) -> DataFrame:
    """rows with cw, the count of w where w is outside the vocabulary (null: not seen). Only rows of such words are joined."""
    return rows.filter("rare_w").join(rarer, "w", "left").unionByName(rows.filter("not rare_w").withColumn("cw", F.lit(None).cast("long")))


def rare_pair_counts(rows: DataFrame, rarer: DataFrame, sent) -> DataFrame:
    """(h, w, rare_h, c, p, hid) of the training rows' pairs: how often they occur, p(w), and the context's id (the class: outside)."""
    summed = rows.groupBy("h", "w", "rare_h", "rare_w").agg(F.sum("times").alias("c"))

    def known(batches):
        v = sent.value
        for b in batches:
            p = v.probability(v.of_hashes(b["w"].to_numpy().view(np.uint64)), b["cw"].fill_null(0).to_numpy())
            hid = v.of_hashes(b["h"].to_numpy().view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["h"], b["w"], b["rare_h"], b["c"], pa.array(p), pa.array(hid)], ["h", "w", "rare_h", "c", "p", "hid"])

    return counted_words(summed, rarer).mapInArrow(releasing(known), "h long, w long, rare_h boolean, c long, p double, hid long")


def _discounted(c, d: np.ndarray):
    """discounted() for a column."""
    return c * F.when(c <= TOP, F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(c, F.lit(TOP)).cast("int") + 1)).otherwise(1.0)


def rare_contexts(rare: DataFrame, d: np.ndarray) -> DataFrame:
    """(h, over, plain, weight) of the contexts outside the vocabulary."""
    sums = rare.filter("rare_h").groupBy("h").agg(F.sum("c").alias("c"), F.sum(_discounted(F.col("c"), d)).alias("m"), F.sum("p").alias("s"))
    full = 1 - F.col("s") < 1e-12
    over = F.when((F.col("c") - F.col("m") < 1e-9) & ~full, F.col("c") + 1).otherwise(F.col("c")).cast("double")
    return sums.select("h", "m", "s", full.alias("plain"), over.alias("over")).select(
        "h", "over", "plain", F.when(F.col("plain"), 0.0).otherwise((1 - F.col("m") / F.col("over")) / F.when(F.col("plain"), 1.0).otherwise(1 - F.col("s"))).alias("weight")
    )


class Contexts:
    """For each context of the vocabulary: the denominator, whether its counts are discounted, and the back-off weight."""

    def __init__(self, vocab: Vocabulary, pairs: DataFrame, rare: DataFrame, sent):
        size = vocab.start + 1

        def tallied(batches):
            seen: dict[int, int] = {}
            for batch in batches:
                for c in batch["counts"].to_pylist():
                    for r, n in zip(*(x.tolist() for x in np.unique(np.frombuffer(_unzip(c), np.int64), return_counts=True))):
                        seen[r] = seen.get(r, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["r", "n"])

        few = pairs.select("counts").mapInArrow(tallied, "r long, n long").filter(F.col("r") <= TOP + 1).groupBy("r").agg(F.sum("n").alias("n")).collect()  # TOP + 1 lines at most
        of_rare = rare.filter(F.col("c") <= TOP + 1).groupBy(F.col("c").alias("r")).agg(F.count("*").alias("n")).collect()  # TOP + 1 lines at most
        n_of: dict[int, int] = {}
        for r in [*few, *of_rare]:
            n_of[int(r["r"])] = n_of.get(int(r["r"]), 0) + int(r["n"])
        self.d = d = discounts(n_of)

        def sums(batches):
            out = np.zeros((3, size))
            for batch in batches:
                for k, c in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                    k, c = _keys(k), np.frombuffer(_unzip(c), np.int64)
                    h, w = (k >> SHIFT).astype(np.int64), (k & np.uint64((1 << 21) - 1)).astype(np.int64)
                    for row, x in zip(out, (c, discounted(c, d), sent.value.p[w])):
                        row += np.bincount(h, x, size)
            at = np.flatnonzero(out[0])
            for lo in range(0, len(at), 1 << 16):
                some = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(row[some]) for row in out)], ["h", "c", "m", "s"])

        packed = pairs.coalesce(pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(releasing(sums), "h long, c double, m double, s double")
        others = rare.filter("not rare_h").select(F.col("hid").alias("h"), F.col("c").cast("double"), _discounted(F.col("c"), d).alias("m"), F.col("p").alias("s"))
        by_context = packed.unionByName(others).groupBy("h").agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.sum("s").alias("s")).toArrow()  # a line for each word of the vocabulary at most
        h, c, m, s = (by_context[x].to_numpy() for x in ("h", "c", "m", "s"))
        full = 1 - s < 1e-12
        over = np.where((c - m < 1e-9) & ~full, c + 1, c)
        self.over, self.plain, self.weight = np.ones(size), np.zeros(size, bool), np.ones(size)
        self.over[h], self.plain[h] = over, full
        self.weight[h] = np.where(full, 0.0, (1 - m / over) / np.where(full, 1.0, 1 - s))

    def score(self, vocab: Vocabulary, key: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 p(w | h) of pairs with their counts (0: unseen)."""
        h, w = (key >> SHIFT).astype(np.int64), (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        return self.log(self.over[h], self.plain[h], self.weight[h], vocab.p[w], c)

    def log(self, over: np.ndarray, plain: np.ndarray, weight: np.ndarray, p: np.ndarray, c: np.ndarray) -> np.ndarray:
        seen = np.where(plain, c, discounted(c, self.d)) / over
        with np.errstate(divide="ignore"):
            return np.log10(np.where(c > 0, seen, weight * p))


def scored_pairs(keyed: DataFrame, pairs: DataFrame, vocab, contexts, buckets: int) -> DataFrame:
    """(k, text) -> (k, pair_score): the sum over each row's pairs."""

    def local(batches):
        part, number = TaskContext.get().partitionId(), 0
        for (k,), h, bounds in _flushes(batches, ["k"]):
            k = k.to_numpy()
            number += 1
            flush = part << 32 | number
            key, row = vocab.value.pairs(h, bounds)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order].astype(np.uint32)
            order = np.argsort(b := bucket_of(mix(key), buckets), kind="stable")
            b, key, row = b[order], key[order], row[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64), len(b)].astype(np.int64)
            packed, times, rows = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                u = np.flatnonzero(np.r_[True, key[lo + 1 : hi] != key[lo : hi - 1]])
                packed.append(_deltas(key[lo:hi][u]))
                times.append(_zip(np.diff(np.r_[u, hi - lo]).astype(np.uint32).tobytes()))
                rows.append(_zip(row[lo:hi].astype(np.uint32).tobytes()))
            at = b[cuts[:-1]]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[at, bucket_of(mix(np.array([flush], np.uint64)), buckets)].astype(np.int32)), pa.array(np.full(n + 1, flush, np.int64)), pa.array([*packed, None], pa.binary()), pa.array([*times, None], pa.binary()), pa.array([*rows, None], pa.binary()), pa.array([None] * n + [k.tobytes()], pa.binary())],
                ["bucket", "flush", "keys", "times", "rows", "ks"],
            )

    def evaluate(sent: pa.Table, table: pa.Table) -> pa.Table:
        known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist()):
            known, counts = _keys(k), np.frombuffer(_unzip(c), np.int64)
        out = []
        for flush, key, times, rows, ks in zip(*(sent[x].to_pylist() for x in ("flush", "keys", "times", "rows", "ks"))):
            if ks is not None:
                out.append((flush, None, None, ks))
                continue
            key, times, rows = _keys(key), np.frombuffer(_unzip(times), np.uint32), np.frombuffer(_unzip(rows), np.uint32)
            c = np.zeros(len(key), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                c = np.where(known[at] == key, counts[at], 0)
            total = np.bincount(rows, np.repeat(contexts.value.score(vocab.value, key, c), times))
            hit = np.unique(rows)
            out.append((flush, hit.astype(np.uint32).tobytes(), total[hit].tobytes(), None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["flush", "rows", "sums", "ks"])

    def gather(group: pa.Table) -> pa.Table:
        k = np.frombuffer(next(x for x in group["ks"].to_pylist() if x is not None), np.int64)
        total = np.zeros(len(k))
        for rows, sums in zip(group["rows"].to_pylist(), group["sums"].to_pylist()):
            if rows is not None:
                np.add.at(total, np.frombuffer(rows, np.uint32), np.frombuffer(sums, np.float64))
        return pa.table({"k": k, "pair_score": total})

    sent = keyed.select("k", "text").mapInArrow(releasing(local), "bucket int, flush long, keys binary, times binary, rows binary, ks binary")
    parts = sent.groupBy("bucket").cogroup(pairs.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(evaluate, "flush long, rows binary, sums binary, ks binary")
    return parts.groupBy("flush").applyInArrow(gather, "k long, pair_score double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_size: int = VOCABULARY) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("i"), held.alias("held"), F.coalesce(text_col, F.lit("")).alias("text"))
    train = keyed.filter(~F.col("held"))
    volume = text_bytes(keyed) / 6
    counts = stored(word_counts(train, buckets_for(volume / 8)), "words", "bucket")
    vocab = vocabulary(counts, train.count(), vocabulary_size)
    sent = spark.sparkContext.broadcast(vocab)
    buckets = buckets_for(volume)

    def look(batches):
        v, j = sent.value, TaskContext.get().partitionId() << 40
        for (k, i, out), h, bounds in _flushes(batches, ["k", "i", "held"]):
            row = np.repeat(np.arange(len(k)), np.diff(bounds))
            ids = v.ids(h)
            mine = ids != v.other
            known = np.bincount(row[mine], minlength=len(k)) + (v.docs > 0)
            base = np.bincount(row[mine], v.base[ids[mine]], len(k)) + v.base[v.end]
            before, token, row = chained(ids, bounds, v.start, v.end)
            rare = (before == v.other) | (token == v.other)
            before, token, _ = chained(h, bounds, START, END)
            cuts = np.searchsorted(row[rare], np.arange(len(k) + 1)) * 2
            both = np.stack([before[rare], token[rare]], axis=1).ravel()
            number = j + np.arange(len(k))
            j += len(k)
            yield pa.RecordBatch.from_arrays([pa.array(number), k, i, out, pa.array(np.diff(bounds) + 1), pa.array(known.astype(np.int64)), pa.array(base), binary(both, cuts)], ["j", "k", "i", "held", "n", "known", "base", "rare"])

    # a row's number j is fixed by writing it
    looked = stored(keyed.mapInArrow(releasing(look), f"j long, k long, i {docs.schema[id_col].dataType.simpleString()}, held boolean, n long, known long, base double, rare binary"), "looked")
    rarer = counts.filter(F.col("c") < vocab.least).select("w", F.col("c").alias("cw"))
    rare = stored(rare_pair_counts(rare_pairs(looked.filter("not held"), sent), rarer, sent), "rare_pairs")
    pairs = stored(pair_counts(train, sent, buckets), "pairs", "bucket")
    levels = Contexts(vocab, pairs, rare, sent)
    contexts = spark.sparkContext.broadcast(levels)
    # written, so that its exchanges are gone and its workers idle before the joins of rarer words begin
    by_pairs = stored(scored_pairs(keyed, pairs, sent, contexts, buckets).groupBy("k").agg(F.max("pair_score").alias("pair_score")), "pair_scores")

    rows = counted_words(rare_pairs(looked, sent), rarer)
    inside = rows.filter("not rare_h").join(rare.filter("not rare_h").select("h", "w", "c"), ["h", "w"], "left")
    outside = rows.filter("rare_h").join(rare.filter("rare_h").select("h", "w", "c"), ["h", "w"], "left").join(rare_contexts(rare, levels.d), "h", "left")
    columns = ["j", "h", "w", "times", "cw", "c"]

    def finish(batches):
        v, x = sent.value, contexts.value
        for b in batches:
            hid, wid = (v.of_hashes(b[name].to_numpy().view(np.uint64)) for name in ("h", "w"))
            times, cw, c = (b[name].fill_null(0).to_numpy() for name in ("times", "cw", "c"))
            mine, rare_w = hid != v.other, wid == v.other
            over, weight = (b[name].fill_null(1.0).to_numpy() for name in ("over", "weight"))
            plain = b["plain"].fill_null(False).to_numpy(zero_copy_only=False)
            over, plain, weight = (np.where(mine, own[hid], other) for own, other in ((x.over, over), (x.plain, plain), (x.weight, weight)))
            score = times * x.log(over, plain, weight, v.probability(wid, cw), c)
            yield pa.RecordBatch.from_arrays(
                [b["j"], pa.array(np.where(rare_w & (cw > 0), times, 0)), pa.array(np.where(rare_w, times * v.base_of(cw), 0.0)), pa.array(score)], ["j", "more_known", "more_base", "more_score"]
            )

    with_rare = outside.select(*columns, "over", "plain", "weight").unionByName(inside.select(*columns), allowMissingColumns=True)
    of_rare = with_rare.mapInArrow(releasing(finish), "j long, more_known long, more_base double, more_score double").groupBy("j").agg(*[F.sum(x).alias(x) for x in ("more_known", "more_base", "more_score")])
    zero = F.lit(0.0)
    return looked.drop("rare").join(by_pairs, "k", "left").join(of_rare, "j", "left").select(
        F.col("i").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("pair_score") + F.coalesce("more_score", zero)).alias("score"),
    )
