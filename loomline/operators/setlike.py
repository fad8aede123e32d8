"""Joins and set operations that come up again: classify two sides, precedence unions, orphans, trigram neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """key and side: old, new, both or (with same, over o and n aliases) changed."""
    both = F.when(~same, "changed").otherwise("both") if same is not None else F.lit("both")
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.when(F.col(f"n.{key}").isNull(), "old").when(F.col(f"o.{key}").isNull(), "new").otherwise(both).alias("side"))


def precedence_union(frames: list[DataFrame], key: str, last_wins: bool = False) -> DataFrame:
    """One row a key, from the first (or last) frame that has it; a hot key is pre-aggregated before the shuffle."""
    placed = [f.withColumn("__src", F.lit(k)) for k, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    columns = [c for c in rows.columns if c not in (key, "__src")]
    pick = F.max_by if last_wins else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*columns), F.struct("__src", *columns)).alias("x")).select(key, "x.*")


def orphans(held: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key no user refers to; null keys are never orphans. Fails rather than guesses if a user could not be read (None)."""
    if any(u is None for u in used):
        raise ValueError("a source of references could not be read; nothing is an orphan until it can be")
    refs = reduce(DataFrame.unionByName, [u.select(key) for u in used]).filter(F.col(key).isNotNull())
    return held.filter(F.col(key).isNotNull()).join(refs, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new replaces old by key. Parquet has no MERGE: the result is written as a new version of the table."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order, by a pre-aggregated max instead of a window over all rows."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def trigrams(word: Column) -> Column:
    """Distinct runs of three characters; none for shorter words."""
    return F.when(F.length(word) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))))


def trigram_neighbours(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, shared): vocabulary terms that share a trigram with a word, and how many."""
    left = words.select("word", F.explode(trigrams(F.col("word"))).alias("g"))
    right = vocabulary.select("term", F.explode(trigrams(F.col("term"))).alias("g"))
    return left.join(right, "g").groupBy("word", "term").agg(F.count("*").alias("shared"))


def deletions(word: Column) -> Column:
    """The word itself and what is left of it without one character."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.array_prepend(without, word))


def one_edit_neighbours(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term): pairs that share a form with at most one character deleted, which every pair within one edit or swap does. An equality join
    on some ten forms a word, where sharing a trigram would join each word with a large part of the vocabulary."""
    left = words.select("word", F.explode(deletions(F.col("word"))).alias("form"))
    right = vocabulary.select("term", F.explode(deletions(F.col("term"))).alias("form"))
    return left.join(right, "form").select("word", "term").distinct()
