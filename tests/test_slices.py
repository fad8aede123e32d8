"""The feed in slices: stopped within a slice and started again, every row comes once."""

from __future__ import annotations

import json
import random
import sqlite3
import time

import pytest

from loomline.sources import slices


@pytest.fixture
def feed(tmp_path):
    """Three months and a bit, many rows of one date, and an empty month."""
    rng = random.Random(2)
    begin = slices.bounds_of("2024-11")[0]
    dates = [begin + rng.randrange(0, 40 * 86_400) // 5000 * 5000 for _ in range(400)] + [slices.bounds_of("2025-01")[1] + k // 3 for k in range(90)]
    rows = [(d, k, f"row {k}") for k, d in enumerate(dates)]
    with sqlite3.connect(tmp_path / "feed.db") as db:
        db.execute("create table feed(date integer, id integer, body text)")
        db.execute("create index by_date on feed(date, id)")
        db.executemany("insert into feed values (?, ?, ?)", rows)
    return str(tmp_path / "feed.db"), rows


def test_months_in_the_fixed_offset():
    assert slices.month_of(1_735_678_799) == "2024-12" and slices.month_of(1_735_678_800) == "2025-01"  # 2024-12-31T21:00:00Z
    assert slices.bounds_of("2024-12")[1] == slices.bounds_of("2025-01")[0] == 1_735_678_800
    assert slices.months(slices.bounds_of("2024-11")[0], slices.bounds_of("2025-01")[1] - 1) == ["2025-01", "2024-12", "2024-11"]


def test_steps_cover_every_row_once(feed):
    path, rows = feed
    options = {"path": path, "page": "7", "pages": "2", "open": "2"}
    reader = slices._SliceReader(options)
    at, got = reader.initialOffset(), []
    for step in range(200):
        if step % 3 == 1:  # another process goes on from the offset alone
            reader = slices._SliceReader(options)
            assert reader.partitions(at, at) == []
        end = reader.latestOffset()
        if end == at:
            break
        parts = reader.partitions(json.loads(json.dumps(at)), json.loads(json.dumps(end)))
        assert len(parts) <= 2
        batch = [r for p in parts for r in reader.read(p)]
        assert batch == [r for p in parts for r in slices._SliceReader(options).read(p)]  # a lost executor's partition again
        assert all(len([r for r in batch if r[0] == p.value[0]]) <= 14 for p in parts)
        got += batch
        at = end
    assert sorted(r[1:] for r in got) == sorted(rows) and set(at["slices"].values()) == {"done"}
    assert all(slices.month_of(d) == m for m, d, _, _ in got)


def test_rows_that_come_later_are_left_out(feed):
    path, rows = feed
    reader = slices._SliceReader({"path": path, "page": "50", "open": "9"})
    at = reader.initialOffset()
    with sqlite3.connect(path) as db:
        db.execute("insert into feed values (?, 9999, 'late')", (at["until"] + 5,))
    got = []
    while (end := reader.latestOffset()) != at:
        got += [r for p in reader.partitions(at, end) for r in reader.read(p)]
        at = end
    assert len(got) == len(rows) and 9999 not in {r[2] for r in got}


def test_an_empty_feed(tmp_path):
    with sqlite3.connect(tmp_path / "f.db") as db:
        db.execute("create table feed(date integer, id integer, body text)")
    reader = slices._SliceReader({"path": str(tmp_path / "f.db")})
    assert reader.latestOffset() == {"until": None, "slices": {}} and reader.partitions(reader.at, reader.at) == []


def test_the_rate_is_kept(feed):
    path, _ = feed
    reader = slices._SliceReader({"path": path, "page": "10", "pages": "4", "open": "1", "rate": "20"})
    start, end = reader.initialOffset(), reader.latestOffset()
    began = time.monotonic()
    assert len(list(reader.read(reader.partitions(start, end)[0]))) == 40 and time.monotonic() - began >= 0.15


def test_a_query_stopped_within_a_slice_goes_on(spark, feed, tmp_path):
    path, rows = feed
    spark.dataSource.register(slices.SliceSource)

    def start():
        stream = spark.readStream.format("slices").options(path=path, page="5", pages="4", open="2").load()
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()

    q = start()
    for _ in range(600):
        if q.lastProgress and q.lastProgress["batchId"] >= 2:
            break
        time.sleep(0.1)
    q.stop()
    some = spark.read.parquet(str(tmp_path / "out"))
    offsets = sorted((tmp_path / "cp/offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    assert 0 < some.count() < len(rows) and any(isinstance(c, list) for c in slices.cursors(offsets[-1].read_text().splitlines()[-1]).values())
    q = start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("date", "id", "body").collect())) == sorted(rows)
