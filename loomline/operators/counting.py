"""Grouped counts with a dimension joined from outside, running and top-k forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.functions.calendar import period
from loomline.session import shared_dir

PERIODS = ("year", "month", "day")


def grouped_count(rows: DataFrame, by: str, when: str, key: str | None = None, own: str | None = None, owner: Column | None = None) -> DataFrame:
    """count, first and last date, and the dimension's title, owner and own flag, by none, a period, or a column.

    rows already hold the (outer joined) dimension: title, subsite_id, subsite_name, own. own='yes' keeps rows of own entries, 'no' the
    others; rows without an entry are foreign. by='none' groups by the empty string, so empty input has no row."""
    is_own = (F.coalesce(F.col("own").cast("int"), F.lit(0)) == 1) | (F.coalesce(F.col("subsite_id") == owner, F.lit(False)) if owner is not None else F.lit(False))
    if own:
        rows = rows.filter(is_own if own == "yes" else ~is_own)
    group = F.lit("") if by == "none" else period(F.col(when), by) if by in PERIODS else F.col(key or by)
    return rows.groupBy(group.alias("grp")).agg(
        F.count("*").alias("n"), F.min(when).alias("first_date"), F.max(when).alias("last_date"), F.max("title").alias("title"),
        F.max("subsite_id").alias("max_subsite"), F.min("subsite_id").alias("min_subsite"), F.max("subsite_name").alias("subsite_name"), F.max(F.col("own").cast("int")).alias("own"),
    )


def count_order(by: str) -> list[Column]:
    """Periods ascending; other groups by falling count, then text."""
    return [F.col("grp")] if by in PERIODS else [F.desc("n"), F.col("grp").cast("string")]


def top_k(rows: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each partition; Spark limits each group before the shuffle as well."""
    return rows.withColumn(rank, F.row_number().over(W.Window.partitionBy(*partition).orderBy(*order))).filter(F.col(rank) <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of an ordered list, numbered from 1."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def clamp_page(number: Column, total: Column, size: int) -> Column:
    """A page number within 1 and the number of pages."""
    return F.greatest(F.lit(1), F.least(number, F.ceil(total / size)))


def greedy_pages(rows: DataFrame, group: str, position: str, weight: str, limit: int) -> DataFrame:
    """group, position, page: a new page begins before a row when the page has reached limit; a fold over each group's rows in order, which
    are one line for each thread of a month, not the rows behind them."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(weight).cast("long").alias("w"))))
    begin = F.struct(F.lit(1).alias("page"), F.lit(0).cast("long").alias("acc"), F.array().cast("array<struct<pos:bigint,page:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = s["acc"] >= limit
        number = F.when(over, s["page"] + 1).otherwise(s["page"])
        return F.struct(number.alias("page"), (F.when(over, F.lit(0).cast("long")).otherwise(s["acc"]) + x["w"]).alias("acc"), F.concat(s["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), number.alias("page")))).alias("out"))

    folded = rows.groupBy(group).agg(lines.alias("lines")).select(group, F.explode(F.aggregate("lines", begin, step, lambda s: s["out"])).alias("x"))
    return folded.select(group, F.col("x.pos").alias(position), F.col("x.page").alias("page"))


def prefix_budget(rows: DataFrame, order: list[Column], size: str, budget: Column | int) -> DataFrame:
    """Rows taken in order until the sum of sizes before a row reaches the budget. The running sum is taken within ranges of the order and
    offset by the sums of the ranges before, so no task sorts all rows: see ranged_sum."""
    return ranged_sum(rows, order, size, "before").filter(F.col("before") < budget).drop("before")


def ranged_sum(rows: DataFrame, order: list[Column], size: str, out: str) -> DataFrame:
    """out: the sum of size over all rows before each in the order. Rows are dealt by range once, for ranges come from a sample and the sums of the
    parts must be of the same; these sums are a line a partition."""
    shared_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("__p").agg(F.sum(size).alias("__s"))
    ahead = sums.withColumn("__base", F.coalesce(F.sum("__s").over(W.Window.orderBy("__p").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = W.Window.partitionBy("__p").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(ahead), "__p").withColumn(out, F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("__base")).drop("__p", "__base")
