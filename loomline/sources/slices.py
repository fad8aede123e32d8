"""A feed read as a stream in slices of a month, each with a cursor of its own, that goes on after a stop where it was.

    spark.dataSource.register(SliceSource)
    spark.readStream.format("slices").option("path", file).option("table", name).load()

The feed lists rows newest first and gives the page after a (date, id). A month is one slice; the newest slices are read first, some at a time, each
from its end downwards. The stream's offset is a map from slice to cursor, the last (date, id) read, or done; a batch moves each open slice on by a number
of pages. What a batch reads is fixed by its two offsets: the executors page from one cursor to the other, a partition a slice, so a batch that runs
again reads the same rows, and no row comes twice or is lost, wherever the query was stopped. The driver asks the feed only for the cursor
that ends the next step. Rows newer than option until (what the feed had when the stream began) are left to a later read of its head.

Options: page (rows a page, 30), pages (a slice and batch, 10), open (slices at once, 4), rate (pages a second and slice, 0: no limit), until (a
date), feed (module:class of another feed than a SQLite table with date, id and body).
"""

from __future__ import annotations

import importlib
import json
import sqlite3
import time
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loomline.session import OFFSET

DONE = "done"
_ZONE = timezone(timedelta(hours=int(OFFSET[:3]), minutes=int(OFFSET[4:])))


def month_of(date: int) -> str:
    return datetime.fromtimestamp(date, _ZONE).strftime("%Y-%m")


def bounds_of(month: str) -> tuple[int, int]:
    """First second of a month, and of the next one."""
    year, number = map(int, month.split("-"))
    first = datetime(year, number, 1, tzinfo=_ZONE)
    return int(first.timestamp()), int(datetime(year + number // 12, number % 12 + 1, 1, tzinfo=_ZONE).timestamp())


def months(low: int, high: int) -> list[str]:
    """Months from that of one date to that of another, the newest first."""
    out, at = [], high
    while at >= bounds_of(month_of(low))[0]:
        out.append(month_of(at))
        at = bounds_of(out[-1])[0] - 1
    return out


class SqliteFeed:
    """A table (date, id, body) of a SQLite file as a feed. The file must be reachable from the executors; an index on (date, id) makes a page a
    short read."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "feed")

    def _rows(self, sql: str, *values) -> list[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            return db.execute(sql.format(table=f'"{self.table}"'), values).fetchall()

    def span(self) -> tuple[int, int] | None:
        """Oldest and newest date."""
        low, high = self._rows("SELECT min(date), max(date) FROM {table}")[0]
        return None if low is None else (low, high)

    def boundary(self, low: int, after: tuple[int, int], n: int) -> tuple[int, int] | None:
        """The n-th row after a cursor, if there are as many from low on."""
        found = self._rows("SELECT date, id FROM {table} WHERE (date, id) < (?, ?) AND date >= ? ORDER BY date DESC, id DESC LIMIT 1 OFFSET ?", *after, low, n - 1)
        return found[0] if found else None

    def page(self, low: int, after: tuple[int, int], n: int) -> list[tuple]:
        """The n rows after a cursor, from low on."""
        return self._rows("SELECT date, id, body FROM {table} WHERE (date, id) < (?, ?) AND date >= ? ORDER BY date DESC, id DESC LIMIT ?", *after, low, n)


def _feed(options: dict):
    module, _, name = options.get("feed", f"{__name__}:SqliteFeed").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class SliceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slices"

    def schema(self) -> str:
        return "slice string, date bigint, id bigint, body string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _SliceReader(dict(self.options))


class _SliceReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.feed = options, _feed(options)
        self.page, self.pages, self.open, self.rate = int(options.get("page", 30)), int(options.get("pages", 10)), int(options.get("open", 4)), float(options.get("rate", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        """No slice yet, and what counts as the newest date."""
        span = self.feed.span()
        until = int(self.options["until"]) if "until" in self.options else span[1] if span else None
        self.at = {"until": until, "slices": {}}
        return self.at

    def _begin(self, month: str, until: int) -> tuple[int, int]:
        """The cursor before the first row of a slice."""
        return min(bounds_of(month)[1], until + 1), -(1 << 62)

    def latestOffset(self) -> dict:
        """One step of each open slice on from where the stream is."""
        at = self.at or self.initialOffset()
        if at["until"] is None:  # the feed was empty
            at = self.initialOffset()
        span, slices = self.feed.span(), dict(at["slices"])
        if span and at["until"] is not None and span[0] <= at["until"]:
            left = [m for m in months(span[0], at["until"]) if slices.get(m) != DONE][: self.open]
            for month in left:
                cursor = tuple(slices.get(month) or self._begin(month, at["until"]))
                end = self.feed.boundary(bounds_of(month)[0], cursor, self.page * self.pages)
                slices[month] = list(end) if end else DONE
        self.at = {"until": at["until"], "slices": slices}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """After a restart Spark first tells where the stream is by an empty range."""
        self.at = end
        moved = {m: c for m, c in end["slices"].items() if start["slices"].get(m) != c}
        return [InputPartition((m, start["slices"].get(m) or list(self._begin(m, end["until"])), c)) for m, c in moved.items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        month, cursor, end = partition.value
        low, began = bounds_of(month)[0], time.monotonic()
        at, last, pages = tuple(cursor), None if end == DONE else tuple(end), 0
        while last is None or at > last:
            rows = self.feed.page(low, at, self.page)
            for date, key, body in rows:
                if last is not None and (date, key) < last:
                    return
                yield month, date, key, body
            if not rows:
                return
            at, pages = (rows[-1][0], rows[-1][1]), pages + 1
            if self.rate:
                time.sleep(max(0.0, began + pages / self.rate - time.monotonic()))


def cursors(offset: str) -> dict:
    """The map of an offset as it stands in a query's checkpoint."""
    return json.loads(offset)["slices"]
