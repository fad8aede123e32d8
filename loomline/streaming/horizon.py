"""Sightings of items within a refresh horizon, as a stream with state that ends: versions in a map, a timer an item.

An item is read again for a horizon after it was last seen. When event time has passed that, a timer settles it; a later sighting reopens it.
A version that is replaced is told once (edit), a removal and a return when they say something new. A sighting that comes late, before
the item's last one but within the watermark, changes nothing that is current; if it shows a version that was not known, that one is told as
found. State of an item is its last sighting and a map from version to when it was told; the map's entries end after a time to live.

batch() gives the same of all sightings at once, by windows. A settling is told as far as the watermark has come.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

OUT = "item long, seen timestamp, event string, sig string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def _ms(t: datetime) -> int:
    return round(t.timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Refresh(StatefulProcessor):
    """horizon and ttl in milliseconds (ttl 0: versions are kept for good)."""

    def __init__(self, horizon: int, ttl: int = 0):
        self.horizon, self.ttl = horizon, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        last = StructType([StructField("seen", LongType()), StructField("sig", StringType()), StructField("stub", BooleanType()), StructField("event", StringType()), StructField("settled", BooleanType())])
        self.last = handle.getValueState("last", last)
        self.versions = handle.getMapState("versions", StructType([StructField("sig", StringType())]), StructType([StructField("told", LongType())]), self.ttl or None)

    def _told(self, sig: str, seen: int) -> bool:
        """Whether a version is new; it is known from now on."""
        if self.versions.containsKey((sig,)):
            return False
        self.versions.updateValue((sig,), (seen,))
        return True

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        seen, sig, stub, event, settled = known or (None, None, None, None, False)
        before, item = seen, key[0]
        row = lambda at, name, what=None: Row(item=item, seen=_time(at), event=name, sig=what)
        for r in sorted(rows, key=lambda r: (r["seen"], r["stub"], r["sig"] or "")):
            at = _ms(r["seen"])
            if seen is not None and at < seen:
                if not r["stub"] and r["sig"] != sig and self._told(r["sig"], at):
                    yield row(at, "found", r["sig"])
                continue
            if seen is not None and at > seen + self.horizon:  # its timer, if it has not gone off yet, says no more
                if not settled:
                    yield row(seen + self.horizon, "settled")
                yield row(at, "reopened")
            settled = False
            if r["stub"] and stub is False and event != "removed":
                event = "removed"
                yield row(at, event)
            elif not r["stub"]:
                if stub and event == "removed":
                    event = "restored"
                    yield row(at, event)
                if stub is False and sig != r["sig"] and self._told(sig, at):
                    yield row(at, "edit", sig)
            seen, sig, stub = at, r["sig"], r["stub"]
        if before is not None and seen != before:
            self.handle.deleteTimer(before + self.horizon)
        if seen is not None:
            self.last.update((seen, sig, stub, event, settled))
            if not settled:
                self.handle.registerTimer(seen + self.horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, sig, stub, event, settled = self.last.get()
        if not settled and seen + self.horizon <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((seen, sig, stub, event, True))
            yield Row(item=key[0], seen=_time(seen + self.horizon), event="settled", sig=None)


def prepare(spark: SparkSession) -> None:
    """State with timers and maps needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def refreshed(sightings: DataFrame, horizon: int = 30 * DAY, delay: str = "1 day", ttl: int = 0) -> DataFrame:
    """sightings (stream): item, seen, sig, stub -> item, seen, event (edit, found, removed, restored, settled, reopened), sig. Rows behind the
    watermark by more than delay are dropped by Spark."""
    prepare(sightings.sparkSession)
    rows = sightings.select("item", "seen", "sig", "stub").withWatermark("seen", delay)
    return rows.groupBy("item").transformWithState(Refresh(horizon, ttl), OUT, "append", "eventtime")


def batch(sightings: DataFrame, horizon: int = 30 * DAY, watermark: datetime | None = None) -> DataFrame:
    """What the stream tells of sightings that it has read in order up to a watermark (null: none of the last settlings), by windows."""
    from loomline.streaming.history import changes_batch

    w = W.Window.partitionBy("item").orderBy("seen")
    gaps = sightings.select("item", "seen", F.lead("seen").over(w).alias("next"))
    end = F.timestamp_millis(F.unix_millis("seen") + horizon)
    over = F.col("next") > end
    none = F.lit(None).cast("string").alias("sig")
    closed = over if watermark is None else over | (F.col("next").isNull() & (end <= F.lit(watermark)))
    settled = gaps.filter(closed).select("item", end.alias("seen"), F.lit("settled").alias("event"), none)
    reopened = gaps.filter(over).select("item", F.col("next").alias("seen"), F.lit("reopened").alias("event"), none)
    return changes_batch(sightings).unionByName(settled).unionByName(reopened)
