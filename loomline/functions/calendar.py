"""Dates of epoch seconds and timestamps in a fixed offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.session import OFFSET

FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "human": "dd.MM.yyyy HH:mm", "iso": "yyyy-MM-dd'T'HH:mm:ss"}


def local(ts: Column) -> Column:
    """A timestamp as the wall clock of the offset. Timestamps without a zone count as UTC."""
    return F.from_utc_timestamp(ts.cast("timestamp"), OFFSET)


def period(ts: Column, unit: str) -> Column:
    """year, month, day, human or iso of a timestamp."""
    return F.date_format(local(ts), FORMATS[unit])


def day_start(text: Column, end: bool = False) -> Column:
    """Epoch seconds at which a day (first 10 characters, ISO) begins in the offset; end: the day after. A bad date gives null."""
    day = F.try_to_timestamp(F.concat(F.left(text, F.lit(10)), F.lit(f" 00:00:00{OFFSET}")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.unix_timestamp(day) + (86_400 if end else 0)


def in_days(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """since <= ts < until + 1 day, whole days of the offset; pushed down as two comparisons."""
    ok = F.lit(True)
    if since:
        ok &= F.lit(since + " 00:00:00" + OFFSET).cast("timestamp") <= ts
    if until:
        ok &= ts < F.lit(until + " 00:00:00" + OFFSET).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    return ok


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def month_slices(start: Column, now: Column) -> Column:
    """Month starts from start to two days after now, as an array of dates: one backfill slice each."""
    return F.sequence(F.trunc(start, "MM"), F.trunc(F.date_add(now, 2), "MM"), F.expr("INTERVAL 1 MONTH"))
