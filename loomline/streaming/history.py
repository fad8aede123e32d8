"""Streams: sightings of items become edits and events with state by item; late and repeated rows within a horizon are dropped once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "item long, seen timestamp, event string, sig string"
STATE = "last_sig string, last_stub boolean, last_event string, kept string"


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as they land, at most a hundred a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One item's new sightings in order against what was known of it."""
    sig, stub, event, kept = state.get if state.exists else (None, None, None, "")
    versions = set(filter(None, kept.split(",")))
    out = []
    for row in pd.concat(list(batches)).sort_values("seen").itertuples():
        if row.stub and stub is False and event != "removed":
            event = "removed"
            out.append((key[0], row.seen, event, None))
        elif not row.stub:
            if stub and event == "removed":
                event = "restored"
                out.append((key[0], row.seen, event, None))
            if stub is False and sig != row.sig and sig not in versions:
                versions.add(sig)
                out.append((key[0], row.seen, "edit", sig))
        sig, stub = (row.sig, bool(row.stub))
    state.update((sig, stub, event, ",".join(sorted(versions))))
    yield pd.DataFrame(out, columns=["item", "seen", "event", "sig"])


def changes(sightings: DataFrame) -> DataFrame:
    """sightings (stream): item, seen, sig, stub -> edits (the replaced signature, once each), removals and returns."""
    return sightings.groupBy("item").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def changes_batch(sightings: DataFrame) -> DataFrame:
    """The same over all sightings at once, by windows; what the stream gives when it has read them in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("item").orderBy("seen")
    rows = sightings.withColumns({"b_sig": F.lag("sig").over(w), "b_stub": F.lag("stub").over(w)})
    edits = rows.filter(~F.col("stub") & (F.col("b_stub") == F.lit(False)) & (F.col("sig") != F.col("b_sig"))).groupBy("item", F.col("b_sig").alias("sig")).agg(F.min("seen").alias("seen"))
    turned = rows.filter((F.col("stub") != F.col("b_stub")) & F.col("b_stub").isNotNull()).select("item", "seen", F.when(F.col("stub"), "removed").otherwise("restored").alias("event"))
    from loomline.operators.versions import events

    told = events(turned, ["item"], ["seen"]).select("item", "seen", "event", F.lit(None).cast("string").alias("sig"))
    return edits.select("item", "seen", F.lit("edit").alias("event"), "sig").unionByName(told)


def within_horizon(rows: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "30 days") -> DataFrame:
    """Rows not seen within the horizon; later ones are ignored until a full read."""
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, ts: str, by: str, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window, final when the watermark has passed."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def upserted(stream: DataFrame, table: str, key: str, checkpoint: str, order: tuple[str, ...] = ()):
    """A stream of rows kept as the latest row a key in versioned Parquet: each batch rewrites the table beside the old one and points to it, so a
    repeated batch gives the same table. Of a batch's rows of one key the last by order counts (without one, by all columns). For tables that are large
    beside their batches see sources.buckets."""
    from loomline.operators.setlike import upsert
    from loomline.sources.sinks import current, publish

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = current(spark, table)
        if at and at.endswith(f"/batch-{number}"):
            return
        rest = [c for c in batch.columns if c != key]
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("x")).select(key, "x.*").select(*batch.columns)
        merged = upsert(spark.read.parquet(f"{at}/rows"), rows, key) if at else rows
        publish({"rows": merged}, table, f"batch-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
