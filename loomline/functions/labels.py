"""Numbers as people read them: grouped digits, word forms, sizes, durations and the height of a bar. Null gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of size, each 1024 of the one before, and the no-break space between groups of digits.
UNITS = "Б КБ МБ ГБ ТБ".split()
NO_BREAK = "\u00a0"


def number(n: Column) -> Column:
    """The whole part, its digits in groups of three."""
    return F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit(NO_BREAK))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a word that goes with n: 1, 21; 2 to 4, 22; all others."""
    last_two = F.abs(n.cast("long")) % 100
    last = last_two % 10
    return F.when(last_two.between(11, 19), many).when(last == 1, one).when(last.between(2, 4), few).when(n.isNotNull(), many)


def counted(n: Column, one: str, few: str, many: str) -> Column:
    return F.concat_ws(" ", number(n), plural(n, one, few, many))


def rubles(n: Column) -> Column:
    return F.concat(number(n), F.lit(f"{NO_BREAK}₽"))


def size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1, with one decimal (none for bytes), ties to even."""
    out = F.format_string(f"%.1f {UNITS[-1]}", F.bround(n / F.lit(1024.0 ** (len(UNITS) - 1)), 1))
    for power in range(len(UNITS) - 2, -1, -1):
        decimals = 1 if power else 0
        label = F.format_string(f"%.{decimals}f {UNITS[power]}", F.bround(n / F.lit(1024.0**power), decimals))
        out = F.when(F.abs(n) < 1024.0 ** (power + 1), label).otherwise(out)
    return F.when(n.isNotNull(), out)


def duration(seconds: Column) -> Column:
    """m:ss of seconds, ties to even; empty for null, what is no number, and nothing or less."""
    v = seconds.try_cast("double")
    s = F.when(F.abs(v) < 1e15, F.bround(v)).cast("long")
    return F.when(s > 0, F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))).otherwise("")


def bar(n: Column, most: Column, least: int = 6, room: int = 40) -> Column:
    """Percent of a bar's height, ties to even; null where there is nothing to show."""
    return F.when((n > 0) & (most > 0), F.bround(least + room * n / most).cast("int"))
