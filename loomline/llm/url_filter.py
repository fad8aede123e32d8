"""URL filters: a temporal list join, in DataFrame functions alone.

A list is a log of dated entries: a rule is added with a verdict, or removed. Each addition becomes a validity interval up to the next entry of
its rule. A rule is a host, a domain above it, or a host with the first segments of a path. Every capture is looked up under all rules that
could cover it, as of the time it was fetched: equality of the rule and from <= fetched < to. Of the active rules the most specific decides (most
labels and segments, then block before allow, then the smaller rule).

Captures are joined once for each (url, time), with the number of rows that have it, so an often captured page costs one lookup. Intervals are
broadcast where there are at most MAX_BROADCAST of them; beyond, both sides are shuffled by rule and Spark splits skewed partitions.

Defined results: a null url or time matches nothing (verdict none); an entry with a null rule or time is ignored; of entries of one rule at one
time the last in the order of action then verdict stands; repeated captures stay repeated; empty tables are allowed on both sides. Other
columns of the captures are kept by judge(), whose own start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

MAX_BROADCAST = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and last dot."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path segments, none empty."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def rules_of(url: Column, depth: Column) -> Column:
    """All rules that could cover a URL: its host, the domains above, and the host with the first one to depth segments."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    segments = F.least(F.size(path), depth)
    paths = F.when(segments > 0, F.transform(F.sequence(F.lit(1), segments), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: rule, verdict, action (add or remove), at -> rule, verdict, __from, __to (null: still valid)."""
    log = entries.filter(F.col("rule").isNotNull() & F.col("at").isNotNull()).select("rule", "verdict", "action", "at")
    last = log.groupBy("rule", "at").agg(F.max(F.struct("action", "verdict")).alias("x"))
    after = W.Window.partitionBy("rule").orderBy("at")
    return last.withColumn("__to", F.lead("at").over(after)).filter(F.col("x.action") == "add").select("rule", F.col("x.verdict").alias("verdict"), F.col("at").alias("__from"), "__to")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """captures with __verdict (block, allow or none), __rule and __active, the number of rules active at fetch time."""
    valid = intervals(entries)
    valid = valid.withColumn("__weight", F.size(F.split("rule", r"[./]")))
    depth, count = valid.agg(F.max(F.size(F.split("rule", "/")) - 1), F.count("*")).first()
    asked = captures.select(F.col(url_col).alias("__u"), F.col(at_col).alias("__t")).filter("__u is not null and __t is not null").distinct()
    keys = asked.withColumn("rule", F.explode(rules_of(F.col("__u"), F.lit(depth or 0))))
    side = F.broadcast(valid) if count <= MAX_BROADCAST else valid
    active = keys.join(side, "rule").filter((F.col("__from") <= F.col("__t")) & (F.col("__to").isNull() | (F.col("__t") < F.col("__to"))))
    best = F.min_by(F.struct("verdict", "rule"), F.struct(-F.col("__weight"), F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("rule")))
    verdicts = active.groupBy("__u", "__t").agg(best.alias("__best"), F.count("*").alias("__active"))
    joined = captures.join(verdicts, (F.col(url_col) == F.col("__u")) & (F.col(at_col) == F.col("__t")), "left")
    return joined.select(*[captures[c] for c in captures.columns], F.coalesce("__best.verdict", F.lit("none")).alias("__verdict"), F.col("__best.rule").alias("__rule"), F.coalesce("__active", F.lit(0)).alias("__active"))
