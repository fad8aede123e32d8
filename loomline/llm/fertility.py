"""Quality rules: tokeniser fertility, with rejection bands by language and script.

Public vocabularies read natural prose with few, varied tokens; shouting, symbols, tables and noise cost more tokens a character, fall back to
bytes or repeat few tokens. For every text four measures are taken over its words, each encoded with the space before it: characters a token in
a vocabulary of pieces with byte fallback and in one of byte pairs, the share of byte tokens, and the entropy of the pieces in bits. A word
is encoded once for all its occurrences that a worker has at hand. Words of more than LONG bytes are encoded in parts of LONG.

A band is the median of a measure less LOW, or plus HIGH, robust standard deviations (from the quartile on that side), among all texts of one
language, script and class of length that the plain rules pass. Quartiles come from counts in bins of fixed width, which add up before
any shuffle, so a language that holds most rows is no group of rows. Where fewer than LEAST texts make a band, that of the script and length is
taken; where these are fewer too, nothing is rejected.

Plain rules: a text fails that has fewer than 10 words, or more than a fifth of its words in windows of five that it holds twice or more.

Defined results: null text has no words and fails; a null or blank language counts as unknown and goes by its script; equal rows are judged
alike, each on its own; an empty table gives an empty result. Scripts are told by the leading bytes of UTF-8. Only id, text and language are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from loomline.llm import textkit
from loomline.llm.common import bounded_batches, releasing, skew_join, stored

LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
LONG = 512
#: Words whose tokens a worker keeps.
KEPT_WORDS = 1 << 18
LEAST, LOW, HIGH = 200, 4.5, 6.0
#: Up to so many bands are broadcast; beyond, only those of many rows are.
MAX_BROADCAST_BANDS = 20_000
#: name: (bin width, most, least deviation relative to the median, least deviation, LOW side rejects, HIGH side rejects)
MEASURES = {
    "piece_chars": (0.005, 20.0, 0.01, 0.0, True, True),
    "pair_chars": (0.005, 20.0, 0.01, 0.0, True, True),
    "byte_share": (0.0005, 1.0, 0.0, 0.004, False, True),
    "entropy": (0.02, 20.0, 0.0, 0.1, True, False),
}
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "georgian", "kana", "han", "hangul", "other")

_WORD_GAP = np.zeros(256, bool)
_WORD_GAP[[32, 9, 10, 11, 12, 13]] = True
_LINE_GAP = np.zeros(256, bool)
_LINE_GAP[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SCRIPT = np.full(256, len(SCRIPTS), np.uint8)  # no letter, or not the first byte of one
for _k, _bytes in enumerate(
    [[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], [0xCE, 0xCF], range(0xD0, 0xD4), range(0xD6, 0xD8), range(0xD8, 0xDC), [0xE0], [0xE1], [0xE3], range(0xE4, 0xEA), range(0xEA, 0xEE), [0xCA, 0xCB, 0xCC, 0xCD, 0xD4, 0xD5, 0xDC, 0xDD, 0xDE, 0xDF, 0xF0]]
):
    _SCRIPT[list(_bytes)] = _k


class Vocabularies:
    """Tokens of words by their hash: counts in both vocabularies, byte tokens, and the pieces themselves."""

    def __init__(self, pieces: str, pairs: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(pairs, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.n_pairs = np.zeros(0, np.int64)
        self.ids, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the words with these distinct hashes are kept."""
        if len(self.at) > KEPT_WORDS:
            self.forget()
        known = [self.at.get(h, -1) for h in hashes.tolist()]
        new = [k for k, x in enumerate(known) if x < 0]
        if new:
            raw = data.tobytes()
            words = [[raw[i : min(i + LONG, b)].decode("utf-8", "replace") for i in range(a, b, LONG)] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            encode = self.pairs.encode_ordinary
            pairs = [len(encode(" " + parts[0])) + sum(len(encode(w)) for w in parts[1:]) if parts[1:] else len(encode(" " + parts[0])) for parts in words]
            whole = self.pieces.encode([parts[0] for parts in words], num_threads=1)
            ids = [x if len(parts) == 1 else x + [y for more in self.pieces.encode(parts[1:], num_threads=1) for y in more] for x, parts in zip(whole, words)]
            for k, x in enumerate(new):
                known[x] = self.at[int(hashes[x])] = len(self.n_pairs) + k
            self.n_pairs = np.r_[self.n_pairs, np.array(pairs, np.int64)]
            self.cuts = np.r_[self.cuts, self.cuts[-1] + np.cumsum([len(x) for x in ids])]
            self.ids = np.r_[self.ids, np.array([y for x in ids for y in x], np.int32)]
        return np.array(known, np.int64)


@lru_cache(maxsize=2)
def vocabularies(pieces: str, pairs: str, pattern: str) -> Vocabularies:
    return Vocabularies(pieces, pairs, pattern)


def _by_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's bytes."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][off])


def _same_as_before(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by row and hash, and which of it equal the one before."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    return order, np.r_[False, (r[1:] == r[:-1]) & (x[1:] == x[:-1])] if len(order) else np.zeros(0, bool)


def rules(data: np.ndarray, off: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a slice."""
    n = len(off) - 1
    lead = (data & 0xC0) != 0x80
    starts, ends, lines = textkit.spans(data, off, _LINE_GAP)
    inked = np.r_[0, np.cumsum(~_WORD_GAP[data])]
    with_word = inked[ends] > inked[starts]
    line_row = textkit.row_of(lines)[with_word]
    order, again = _same_as_before(line_row, textkit.span_hashes(data, starts[with_word], ends[with_word]))
    dup_lines = np.bincount(line_row[order][again], minlength=n)
    g, at = textkit.grams(h, bounds, WINDOW)
    row = textkit.row_of(bounds)
    order, again = _same_as_before(row[at], g)
    twice = again | np.r_[again[1:], False] if len(again) else again
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[order][twice], 1)
    np.add.at(edge, at[order][twice] + WINDOW, -1)
    repeated = np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=n)
    return [np.diff(bounds), _by_row(lead & ~_WORD_GAP[data], off), _by_row(_SYMBOL[data], off), dup_lines, repeated]


def scripts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The script of most letters of each row, of equals the first; without letters the last one."""
    kind = _SCRIPT[data]
    most, out = np.zeros(len(off) - 1, np.int64), np.full(len(off) - 1, len(SCRIPTS) - 1)
    for k in np.unique(kind):
        if k < len(SCRIPTS):
            n = _by_row(kind == k, off)
            out[n > most] = k
            most = np.maximum(most, n)
    return out


def tokens(data: np.ndarray, off: np.ndarray, h: np.ndarray, bounds: np.ndarray, known: Vocabularies) -> list[np.ndarray]:
    """Pieces, byte pieces, pairs, and the entropy of pieces in bits, of each row of a slice."""
    n = len(off) - 1
    starts, ends, _ = textkit.spans(data, off, _WORD_GAP)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    place = known.of(distinct, data, starts[first], ends[first])
    # a line for each word of each row, with how often it is there
    key, times = np.unique(textkit.row_of(bounds) * len(distinct) + which, return_counts=True)
    row, word = key // max(1, len(distinct)), place[key % max(1, len(distinct))]
    size = known.cuts[word + 1] - known.cuts[word]
    begin = np.cumsum(size) - size
    ids = known.ids[np.repeat(known.cuts[word] - begin, size) + np.arange(size.sum())]
    of, weight = np.repeat(row, size), np.repeat(times, size)
    pieces, fallback = np.bincount(of, weight, n), np.bincount(of, weight * known.is_byte[ids], n)
    token, at = np.unique(of * known.size + ids, return_inverse=True)
    count = np.bincount(at, weight, len(token))
    inner = np.bincount(token // known.size, count * np.log2(np.maximum(count, 1)), n)
    some = np.maximum(pieces, 1)
    return [pieces, fallback, np.bincount(row, times * known.n_pairs[word], n), np.maximum(0.0, np.log2(some) - inner / some)]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FOUND = ", ".join([f"{c} long" for c in COUNTS] + ["script string"] + [f"{m} double" for m in MEASURES])


def measured(docs: DataFrame, pieces: str, pairs: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, the counts of the plain rules, script, and the measures of every text, which is read once. pieces and pairs: paths of a
    SentencePiece model and of a file of ranks, the same on every executor; pattern: how the latter's vocabulary splits text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    id_kind = to_arrow_type(kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(pieces, pairs, pattern)
        for batch in batches:
            for lo, hi, data, off in textkit.slices(batch["text"]):
                h, bounds = textkit.words(data, off, lower=False)
                counts = rules(data, off, h, bounds)
                n_pieces, fallback, n_pairs, entropy = tokens(data, off, h, bounds, known)
                script = pa.array(SCRIPTS).take(pa.array(scripts(data, off)))
                chars = counts[1]
                values = [chars / np.maximum(1, n_pieces), chars / np.maximum(1, n_pairs), fallback / np.maximum(1, n_pieces), entropy]
                columns = [batch["id"].slice(lo, hi - lo).cast(id_kind), batch["lang"].slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in counts), script, *(pa.array(x.astype(np.float64)) for x in values)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang", *COUNTS, "script", *MEASURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.trim(F.coalesce(F.col(lang_col).cast("string"), F.lit(""))).alias("lang"))
    return rows.mapInArrow(releasing(measure), f"id {kind.simpleString()}, lang string, {FOUND}")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def length_class() -> Column:
    """Lengths from one power of four to the next, the last without end."""
    return F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1))) / 2), F.lit(5)).cast("int")


def bands(rows: DataFrame) -> DataFrame:
    """measured rows -> key, len, n, and low_ and high_ of each measure, for every language with script and for every script as a whole."""
    sound = rows.filter(~base_failed()).withColumn("len", length_class())
    keys = F.array(F.concat_ws("/", "script", "lang"), F.col("script"))
    bins = F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.least(F.col(m), F.lit(most)) / width).cast("int").alias("bin")) for m, (width, most, *_) in MEASURES.items()])
    lines = sound.select(F.explode(F.array_distinct(keys)).alias("key"), "len", F.explode(bins).alias("x")).groupBy("key", "len", "x.m", "x.bin").count()
    upto = W.Window.partitionBy("key", "len", "m").orderBy("bin")
    all_of = W.Window.partitionBy("key", "len", "m")
    shares = lines.withColumn("upto", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(all_of))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin")))
    quartiles = shares.groupBy("key", "len", "m").agg(F.max("n").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    out = []
    for m, (width, _, share, least, low, high) in MEASURES.items():
        middle = (F.col("q2") + 0.5) * width
        spread = lambda bins, middle=middle, width=width, share=share, least=least: F.greatest(bins * width / 0.6745, F.lit(share) * middle, F.lit(least))
        for name, value in (("low", middle - LOW * spread(F.col("q2") - F.col("q1")) if low else F.lit(None)), ("high", middle + HIGH * spread(F.col("q3") - F.col("q2")) if high else F.lit(None))):
            out.append(F.max(F.when(F.col("m") == m, value.cast("double"))).alias(f"{name}_{m}"))
    return quartiles.groupBy("key", "len").agg(F.max("n").alias("n"), *out)


def judged(docs: DataFrame, pieces: str, pairs: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each of docs: id, the counts, base_failed, kept, band (whose band judged it, if any), script and the measures."""
    rows = stored(measured(docs, pieces, pairs, pattern, id_col, text_col, lang_col), "measured").withColumn("len", length_class()).withColumn("key", F.concat_ws("/", "script", "lang"))
    found = stored(bands(rows.drop("key", "len")).filter(F.col("n") >= LEAST), "bands")
    limits = F.struct(*[c for c in found.columns if c.startswith(("low_", "high_"))])
    own = found.filter(F.col("key").contains("/")).select(F.struct("key", "len").alias("g"), "n", limits.alias("own"))
    count, total = own.agg(F.count("*"), F.sum("n")).first()
    placed = rows.withColumn("g", F.struct("key", "len"))
    if count <= MAX_BROADCAST_BANDS:
        placed = placed.join(F.broadcast(own.drop("n")), "g", "left")
    else:
        placed = skew_join(placed, own, "g", "n", total)
    by_script = found.filter(~F.col("key").contains("/")).select(F.col("key").alias("script"), "len", limits.alias("whole"))  # at most a line a script and length
    both = placed.join(F.broadcast(by_script), ["script", "len"], "left").withColumn("limits", F.coalesce("own", "whole"))
    inside = F.lit(True)
    for m, (*_, low, high) in MEASURES.items():
        inside = inside & (F.coalesce(F.col(m) >= F.col(f"limits.low_{m}"), F.lit(True)) if low else F.lit(True)) & (F.coalesce(F.col(m) <= F.col(f"limits.high_{m}"), F.lit(True)) if high else F.lit(True))
    band = F.when(F.col("own").isNotNull(), F.col("key")).when(F.col("whole").isNotNull(), F.col("script"))
    return both.select(F.col("id").alias(id_col), *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), band.alias("band"), "script", *MEASURES)
