"""A table that batches are merged into, of which a batch rewrites only the buckets that it changes.

Rows lie in buckets by a hash of their key, each bucket a folder of Parquet that is never written to again. A merge reads the buckets that hold keys of the
batch, joins them with the batch, and writes anew those in which a row did change; an entry of a log then names the folder of every bucket. So
what a batch costs follows its own keys and not the table, a reader sees one state or the next, and a batch that comes again, after a lost
driver or out of order with the log, changes nothing. Buckets are rehashed to twice as many when their rows exceed a bound.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.session import discard, stored
from loomline.sources.sinks import commit, committed, exists

#: (old, new) -> a frame key, row, events from one with key, o and n (structs or null).
Rule = Callable[[DataFrame], DataFrame]


def latest_wins(joined: DataFrame) -> DataFrame:
    """The batch's row where there is one; what it says is told as insert or update."""
    told = F.when(F.col("n").isNull(), F.array().cast("array<string>")).when(F.col("o").isNull(), F.array(F.lit("insert"))).when(F.col("o") == F.col("n"), F.array().cast("array<string>")).otherwise(F.array(F.lit("update")))
    return joined.select("key", F.coalesce("n", "o").alias("row"), told.alias("events"))


class BucketTable:
    """root: a folder; key: the column that identifies a row; order: of a batch's rows of one key the last by these columns counts, and of
    rows equal in them the largest; buckets: how many to begin with; most: rows a bucket before it is split."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: tuple[str, ...], buckets: int = 16, most: int = 4_000_000):
        self.spark, self.root, self.key, self.order, self.most = spark, root, key, order, most
        self.first = {"buckets": buckets, "folders": {}, "rows": {}, "batches": {}, "schema": None}

    def state(self) -> tuple[int, dict]:
        number, state = committed(self.spark, f"{self.root}/log")
        return number, state or self.first

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _rows(self, state: dict, some: list[int] | None = None) -> DataFrame | None:
        """Rows of some buckets, or of all; none of them may be there yet."""
        folders = [f"{self.root}/data/{f}" for b, f in state["folders"].items() if some is None or int(b) in some]
        schema = StructType.fromJson(state["schema"]) if state["schema"] else None
        if schema is None:
            return None
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        rows = self._rows(self.state()[1])
        if rows is None:
            raise ValueError(f"nothing was merged into {self.root} yet")
        return rows

    def events(self) -> DataFrame:
        """source, batch, key, event: what rules told, of every batch that was committed."""
        schema = f"`{self.key}` string, event string, source string, batch long"
        _, state = self.state()
        if not exists(self.spark, f"{self.root}/events"):
            return self.spark.createDataFrame([], schema)
        there = F.lit(False)
        for source, number in state["batches"].items():  # a batch that was not committed may have left events behind
            there = there | ((F.col("source") == source) & (F.col("batch") <= number))
        return self.spark.read.schema(schema).parquet(f"{self.root}/events").filter(there)

    def _latest(self, batch: DataFrame) -> DataFrame:
        whole = F.struct(*batch.columns)
        return batch.filter(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("key")).agg(F.max_by(whole, F.struct(*self.order, *[c for c in batch.columns if c not in self.order])).alias("n"))

    def merge(self, batch: DataFrame, number: int, source: str = "batch", rule: Rule = latest_wins) -> dict:
        """Merge a batch of a source; -> buckets: how many it touched, rewritten: how many did change, events: how many were told. Batches of a source are numbered
        upwards; one with a number that is there already is passed over."""
        log, state = self.state()
        if number <= state["batches"].get(source, -1):
            return {"buckets": 0, "rewritten": 0, "events": 0}
        n = state["buckets"]
        latest, at_latest = stored(self._latest(batch).withColumn("bucket", self._bucket(F.col("key"), n)), "batch")
        touched = sorted(r[0] for r in latest.select("bucket").distinct().collect())  # no more than there are buckets
        held = self._rows(state, touched)
        shape = StructType.fromJson(state["schema"]) if state["schema"] else batch.schema
        olds = (held if held is not None else self.spark.createDataFrame([], shape)).select(F.col(self.key).alias("key"), F.struct(*shape.names).alias("o"))
        joined = olds.join(latest.select("key", F.struct(*[F.col(f"n.{c}").alias(c) for c in shape.names]).alias("n"), F.lit(True).alias("is_new")), "key", "full_outer")
        both = joined.select("key", "o", F.when(F.col("is_new"), F.col("n")).alias("n"))
        ruled = rule(both).withColumn("bucket", self._bucket(F.col("key"), n))
        done, at_done = stored(ruled.join(olds, "key", "left").withColumn("changed", ~F.col("row").eqNullSafe(F.col("o"))).drop("o"), "merged")
        counts = {r["bucket"]: r for r in done.groupBy("bucket").agg(F.count_if("changed").alias("changed"), F.count("row").alias("rows"), F.sum(F.size("events")).alias("events")).collect()}
        rewritten = sorted(b for b, r in counts.items() if r["changed"])
        told = sum(r["events"] or 0 for r in counts.values())
        name = uuid.uuid4().hex
        new = {**state, "schema": shape.jsonValue(), "batches": {**state["batches"], source: number}, "folders": dict(state["folders"]), "rows": dict(state["rows"])}
        if rewritten:
            self._write(done.filter(F.col("bucket").isin(rewritten)).filter("row is not null").select("bucket", "row.*"), name)
            for b in rewritten:
                new["rows"][str(b)] = counts[b]["rows"]
                new["folders"].pop(str(b), None)
                if counts[b]["rows"]:
                    new["folders"][str(b)] = f"{name}/__bucket={b}"
        if told:
            done.select(F.col("key").cast("string").alias(self.key), F.explode("events").alias("event")).write.mode("overwrite").parquet(f"{self.root}/events/source={source}/batch={number}")
        for at in (at_latest, at_done):
            discard(self.spark, at)
        if not commit(self.spark, f"{self.root}/log", log + 1, new):
            raise RuntimeError(f"another writer merged into {self.root}; merge the batch again")
        if max(new["rows"].values(), default=0) > self.most:
            self.rehash(2 * n)
        return {"buckets": len(touched), "rewritten": len(rewritten), "events": told}

    def _write(self, rows: DataFrame, name: str) -> None:
        """One file a bucket, which holds a bounded number of rows."""
        rows.withColumnRenamed("bucket", "__bucket").repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/data/{name}")

    def rehash(self, buckets: int) -> None:
        """Deal all rows to another number of buckets, as one entry of the log."""
        log, state = self.state()
        name = uuid.uuid4().hex
        dealt = self.read().withColumn("bucket", self._bucket(F.col(self.key), buckets))
        self._write(dealt, name)
        shape = StructType.fromJson(state["schema"])
        counts = {str(r["__bucket"]): r["count"] for r in self.spark.read.schema(shape.add("__bucket", "integer")).parquet(f"{self.root}/data/{name}").groupBy("__bucket").count().collect()}
        if not commit(self.spark, f"{self.root}/log", log + 1, {**state, "buckets": buckets, "rows": counts, "folders": {b: f"{name}/__bucket={b}" for b in counts}}):
            raise RuntimeError(f"another writer merged into {self.root}")

    def follow(self, stream: DataFrame, checkpoint: str, source: str = "stream", rule: Rule = latest_wins):
        """Merge what a stream brings, batch by batch, until it has no more."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number, source, rule)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_rule(owner: int, now: int) -> Rule:
    """How own comments from a feed are merged: author, text, stub, media (are there any), sig, damaged, state and state_at are columns of both.

    A row of another author is passed over. What is archived stays if the fresh copy lost its text, marked with why when it is first seen (removed). Anything else
    takes its place: edit if the signature differs, restored if it was marked before, found where the archived copy was damaged."""
    from loomline.operators.guard import degraded

    def rule(joined: DataFrame) -> DataFrame:
        o, n = F.col("o"), F.col("n")
        foreign = n["author"].isNotNull() & (n["author"] != owner)
        fresh = n.isNotNull() & ~F.coalesce(foreign, F.lit(False))
        sound = o.isNotNull() & ~F.coalesce(o["damaged"], F.lit(False))
        why = F.when(fresh & sound, degraded(o["text"], o["stub"], n["text"], n["stub"], n["media"]))
        kept = F.when(o["state"].isNull() & why.isNotNull(), o.withField("state", why).withField("state_at", F.lit(now).cast("long"))).otherwise(o)
        none = F.lit(None)
        taken = n.withField("state", none.cast("string")).withField("state_at", none.cast("long")).withField("damaged", F.lit(False))
        row = F.when(~fresh | why.isNotNull(), kept).otherwise(taken)
        told = lambda when, name: F.when(F.coalesce(when, F.lit(False)), name)
        events = F.array_compact(F.array(
            told(fresh & o.isNull(), "insert"), told(why.isNotNull() & o["state"].isNull(), "removed"), told(fresh & o.isNotNull() & ~sound, "found"),
            told(fresh & sound & why.isNull() & ~o["sig"].eqNullSafe(n["sig"]), "edit"), told(fresh & sound & why.isNull() & o["state"].isNotNull(), "restored"),
        ))
        return joined.select("key", row.alias("row"), events.alias("events"))

    return rule
