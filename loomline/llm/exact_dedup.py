"""Exact dedup: two passes around a Bloom filter; only rows whose hash may repeat are shuffled.

Pass one reads the texts once and keeps a narrow table of digests, from which the filter of hashes that may occur twice is built. Pass two
probes it: rows that cannot repeat pass straight through, the others are grouped by their whole SHA-256. A filter has a bounded size; where there
are more rows than it can tell apart, hashes fall into ranges, each with a filter of its own that is broadcast in its turn. A hot group is pre-aggregated before
the shuffle and its survivor is broadcast back (skew_join), so a text held by a third of all rows never meets in one task.

Defined results: null text counts as empty, and all empty texts are equal; of rows equal in text, the largest id stays (null ids come last);
of rows equal in text and id, one stays; an empty table gives an empty result. Further columns of the input are kept by deduplicate() and
never read; the digest columns have names that start with two underscores there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.common import skew_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def head(digest: Column) -> Column:
    """A long from the first 15 hex digits: what the filter holds."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _again(digests: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """digests (with h) that cannot repeat, and those that may."""
    spark = digests.sparkSession
    ranges = -(-count * bloom.BITS // bloom.MAX_BITS) or 1
    parts = [digests]
    if ranges > 1:
        dealt = stored(digests.withColumn("range", F.pmod(F.shiftright("h", 7), F.lit(ranges)).cast("int")), "ranges", "range")
        parts = [dealt.filter(F.col("range") == k).drop("range") for k in range(ranges)]
    probed = []
    for part in parts:
        seen = bloom.build(part.select("h"), -(-count // ranges), repeated=True)
        found = part.withColumn("again", bloom.may_have(spark, seen, F.col("h")))
        probed.append(stored(found, "probed") if ranges > 1 else found)
    both = probed[0]
    for part in probed[1:]:
        both = both.unionByName(part)
    return both.filter(~F.col("again")).drop("again"), both.filter("again").drop("again")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256."""
    digests = stored(docs.select(F.col(id_col).alias("i"), text_digest(F.col(text_col)).alias("d")).withColumn("h", head(F.col("d"))).withColumn("r", F.monotonically_increasing_id()), "digests")
    count = digests.count()
    once, again = _again(digests, count)
    single = once.select(F.col("i").alias(id_col), F.col("i").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("d").alias("text_sha256"))
    groups = again.groupBy("d").agg(F.max(F.struct("i", "r")).alias("best"), F.count("*").alias("group_size"), F.count("*").alias("w"))
    joined = skew_join(again.select("i", "d", "r"), groups, "d", "w", count).select(
        F.col("i").alias(id_col), F.col("best.i").alias("keep_id"), "group_size", (F.col("r") == F.col("best.r")).alias("kept"), F.col("d").alias("text_sha256")
    )
    return single.unionByName(joined)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of the texts only those are shuffled whose hash does repeat, or that its filter mistakes for such."""
    spark = docs.sparkSession
    narrow = stored(docs.select(F.col(id_col).alias("i"), text_digest(F.col(text_col)).alias("d")).withColumn("h", head(F.col("d"))), "digests")
    again = _again(narrow, narrow.count())[1]
    best = stored(again.groupBy("d").agg(F.max("i").alias("best"), F.count("*").alias("rows"), F.first("h").alias("h")).filter("rows > 1"), "repeated")
    repeats = bloom.may_have(spark, bloom.build(best.select("h"), best.count()), F.col("__h"))
    probed = docs.withColumn("__d", text_digest(F.col(text_col))).withColumn("__h", head(F.col("__d"))).withColumn("__again", repeats)
    met = probed.filter("__again").join(best.select(F.col("d").alias("__best_d"), "best").withColumnRenamed("best", "__best"), F.col("__d") == F.col("__best_d"), "left")
    alone = met.filter(F.col("__best_d").isNull())
    stay = met.filter(F.col("__best_d").isNotNull() & F.col(id_col).eqNullSafe(F.col("__best"))).dropDuplicates(["__d"])
    return probed.filter(~F.col("__again")).select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(stay.select(*docs.columns))
