"""The refresh horizon as a stream with timers, against windows over all sightings."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest

from loomline.streaming import history, horizon

SCHEMA = "item long, seen timestamp, sig string, stub boolean"
HOUR = 3_600_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "item long, t long, sig string, stub boolean").selectExpr("item", "timestamp_seconds(t * 3600) as seen", "sig", "stub")


def run(spark, tmp_path, batches: list, name: str, delay: str = "2 hours"):
    """Each list of rows is a batch of its own; the query is stopped and started again after each."""
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = history.landed(spark, str(tmp_path / "in"), SCHEMA)
        q = horizon.refreshed(stream, 24 * HOUR, delay).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / name))


@pytest.fixture(autouse=True)
def provider(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def told(df) -> list:
    return sorted((r["item"], r["seen"].timestamp(), r["event"], r["sig"] or "") for r in df.collect())


def test_stream_equals_windows(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted({(i, t): (i, t, rng.choice("AAB"), rng.random() < 0.2) for i in range(6) for t in (rng.randrange(0, 200) for _ in range(9))}.values(), key=lambda r: r[1])
    rows.append((99, 400, "end", False))  # moves the watermark beyond all others
    third = len(rows) // 3
    out = run(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :]], "out")
    watermark = datetime.fromtimestamp((400 - 2) * 3600, timezone.utc)
    want = told(horizon.batch(frame(spark, rows), 24 * HOUR, watermark))
    assert told(out) == want and {x[2] for x in want} >= {"edit", "removed", "settled", "reopened"}


def test_late_sightings(spark, tmp_path):
    """A late row shows a version that was replaced unseen; one behind the watermark is dropped; one after the horizon reopens."""
    batches = [[(1, 10, "A", False), (1, 14, "C", False)], [(1, 12, "B", False), (1, 13, "A", False)], [(2, 100, "x", False)], [(1, 11, "Z", False)], [(1, 101, "C", False)]]
    out = run(spark, tmp_path, batches, "out", "5 hours")
    hours = lambda events: [(i, round(t / 3600), e, s) for i, t, e, s in events]
    assert hours(told(out)) == [(1, 12, "found", "B"), (1, 14, "edit", "A"), (1, 38, "settled", ""), (1, 101, "reopened", "")]
