"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Each source gets a share of the budget by weight, but no more than max_epochs times its own size. The excess of clamped sources is shared
among the others by weight until none is above its cap. With sources in order of cap / weight that fixed point has a closed form: the level
is (budget - caps of the sources before) / (weights from here on) at the first source whose cap reaches the level.

A document then takes floor(target / size) whole repetitions, and the documents of a source that come first in the order of a seeded hash
take one more until the words of the fractional repetition are used up. The end of that run is found from sums per (source, hash bucket),
so only the rows of one bucket a source are ever sorted, and the final pass is a comparison with a line per source.

Defined results: null or empty text has size 0 and takes part with 0 words; a null source is a source of its own, the last; repeated ids of
a source share a draw; a source with no words has target 0; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.llm.common import skew_join, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that make a bucket: 16**3 buckets a source.
BUCKET_DIGITS = 3
#: Up to so many sources their table is broadcast; beyond, only those with many rows are.
MAX_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def draw(id_col: str, seed: int) -> Column:
    """A seeded hash of the id as hex; ids in order of it are in random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, max_epochs: float = 3.0, cycle: int = 3) -> DataFrame:
    """(src, rows, size) -> also target: sources by code point, null last, weigh 1 .. cycle, repeating. One line a source passes through one
    task here; documents do not."""
    order = W.Window.orderBy(F.col("src").isNull(), "src")
    weighed = sizes.withColumn("w", ((F.row_number().over(order) - 1) % cycle + 1).cast("double")).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    by_ratio = W.Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src")
    everything = W.Window.partitionBy()
    level = (F.sum("size").over(everything) - F.sum("cap").over(by_ratio.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) + F.col("cap")) / F.sum("w").over(
        by_ratio.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    )
    found = weighed.withColumn("lam", level).withColumn("lam", F.min(F.when(F.col("lam") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), "src", "lam"))).over(everything)["lam"])
    return found.withColumn("target", F.when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("lam") * F.col("w")))).drop("w", "cap", "lam")


def mix_plan(rows: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """rows: (src, size, u, id) -> a line per source: src, rows, source_size, target, whole, cut_u."""
    sums = stored(rows.groupBy("src", F.substring("u", 1, BUCKET_DIGITS).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sums")
    by_source = targets(sums.groupBy("src").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")), max_epochs)
    plan = by_source.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")).withColumn("more", F.col("target") - F.col("whole") * F.col("size"))
    s = sums.select(F.col("src").alias("s_src"), "b", F.col("size").alias("b_size"))
    ahead = W.Window.partitionBy("s_src").orderBy("b").rowsBetween(W.Window.unboundedPreceding, -1)
    reach = s.withColumn("before", F.coalesce(F.sum("b_size").over(ahead), F.lit(0))).join(plan, F.col("s_src").eqNullSafe(F.col("src"))).filter((F.col("before") <= F.col("more")) & (F.col("before") + F.col("b_size") > F.col("more")))
    edge = reach.select(F.col("src").alias("e_src"), F.col("b").alias("e_b"), "before", "more")
    inside = rows.join(F.broadcast(edge) if by_source.count() <= MAX_BROADCAST_SOURCES else edge, F.col("src").eqNullSafe(F.col("e_src")) & (F.substring("u", 1, BUCKET_DIGITS) == F.col("e_b")))
    steps = inside.groupBy("e_src", "u").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("more").alias("more"))
    upto = W.Window.partitionBy("e_src").orderBy("u").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    taken = steps.withColumn("mid", F.col("before") + F.sum("size").over(upto) - F.col("size") / 2).filter(F.col("mid") <= F.col("more"))
    cut = taken.groupBy("e_src").agg(F.max("u").alias("u"))
    edges = edge.select("e_src", "e_b").join(cut.withColumnRenamed("e_src", "c_src"), F.col("e_src").eqNullSafe(F.col("c_src")), "left").select(F.col("e_src"), F.coalesce("u", "e_b").alias("cut_u"))
    return (
        plan.join(edges, F.col("src").eqNullSafe(F.col("e_src")), "left")
        # no bucket reaches the end: the fraction is nothing, or all of it
        .select("src", "rows", F.col("size").alias("source_size"), "target", "whole", F.coalesce("cut_u", F.when(F.col("more") > 0, F.lit("g")).otherwise(F.lit(""))).alias("cut_u"))
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """(id, src, size, u), written once: all that the plan reads."""
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), draw(id_col, seed).alias("u")), "sizes")


def _planned(rows: DataFrame, sizes: DataFrame, max_epochs: float) -> DataFrame:
    """rows with __src, __any (there are words) and __u -> also __source_size, __target and __times."""
    plan = stored(mix_plan(sizes, max_epochs), "plan")
    total, sources = plan.agg(F.sum("rows"), F.count("*")).first()
    lines = plan.select(F.col("src").alias("__src"), F.col("rows").alias("__rows"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("cut_u").alias("__cut_u"))
    if sources <= MAX_BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(lines.drop("__rows").withColumnRenamed("__src", "__p")), F.col("__src").eqNullSafe(F.col("__p")))
    else:
        joined = skew_join(rows, lines, "__src", "__rows", total or 0)
    return joined.withColumn("__times", F.when(F.col("__any"), F.col("__whole") + (F.col("__u") <= F.col("__cut_u")).cast("long")).otherwise(F.lit(0).cast("long")))


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, seed: int = 11) -> DataFrame:
    """id, size, source_size, target and times of each row of docs; texts are read once."""
    sizes = measured(docs, id_col, text_col, source_col, seed)
    rows = sizes.select("id", F.col("src").alias("__src"), "size", F.col("u").alias("__u"), (F.col("size") > 0).alias("__any"))
    return _planned(rows, sizes, max_epochs).select("id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__times").alias("times"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, seed: int = 11) -> DataFrame:
    """docs with __size, __source_size, __target, and __times: how often the mix takes the document."""
    sizes = measured(docs, id_col, text_col, source_col, seed)
    any_word = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))  # finds the first word; sizes are not counted again where they are not asked for
    rows = docs.withColumns({"__src": F.col(source_col), "__size": word_count(F.col(text_col)), "__u": draw(id_col, seed), "__any": any_word})
    return _planned(rows, sizes, max_epochs).select(*docs.columns, "__size", "__source_size", "__target", "__times")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    taken = mixed(docs, **options).filter("__times > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
