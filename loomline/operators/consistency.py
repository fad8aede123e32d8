"""Consistency of a whole archive: constraints are declared, and compiled to one scan a table and one anti join a reference.

    found = check(tables, [Holds("posts", "dated", "date > 0"), Unique("posts", "id"), Refers("comments", "entry_id", "posts", "id"), SameCount(...)])

found has a line a constraint: table, constraint, rows (looked at), bad, examples (some of the smallest keys of what is bad). Conditions and counts
of a table come out of one aggregate over it, whatever their number; a reference or a key needs an exchange of its keys alone. Every part is a frame of few
lines, and the parts are added up by constraint. observed() counts the broken conditions of a frame in the very pass that writes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

EXAMPLES = 5


@dataclass(frozen=True)
class Holds:
    """A condition that every row of a table meets; one that is null is broken."""

    table: str
    name: str
    condition: str
    example: str = "id"


@dataclass(frozen=True)
class Unique:
    table: str
    key: str

    @property
    def name(self) -> str:
        return f"unique {self.key}"


@dataclass(frozen=True)
class Refers:
    """Every value of a column that is not null, in rows that meet where, is a key of another table."""

    table: str
    column: str
    to: str
    key: str
    where: str = "true"

    @property
    def name(self) -> str:
        return f"{self.column} refers to {self.to}.{self.key}"


@dataclass(frozen=True)
class SameCount:
    """As many rows of one table that meet a condition as of another; what is bad is the difference."""

    name: str
    table: str
    where: str
    other: str
    other_where: str = "true"


Constraint = Holds | Unique | Refers | SameCount


PART = ("table", "constraint", "rows", "bad", "example")


def _part(df: DataFrame, table: str, name: str | Column, rows: Column, bad: Column, example: Column) -> DataFrame:
    named = F.lit(name) if isinstance(name, str) else name
    return df.select(F.lit(table).alias("table"), named.alias("constraint"), rows.cast("long").alias("rows"), bad.cast("long").alias("bad"), example.cast("string").alias("example"))


def _scan(table: str, df: DataFrame, rules: list[Holds], counts: list[tuple[str, str, int]]) -> DataFrame:
    """One aggregate over a table. counts: (constraint, condition, sign): what two tables count alike cancels out when parts are added up."""
    broken = [~F.coalesce(F.expr(r.condition), F.lit(False)) for r in rules]
    sums = [F.count("*").alias("n"), *(F.count_if(b).alias(f"b{k}") for k, b in enumerate(broken)), *(F.min(F.when(b, F.col(r.example))).cast("string").alias(f"e{k}") for k, (r, b) in enumerate(zip(rules, broken)))]
    sums += [F.count_if(F.expr(where)).alias(f"c{k}") for k, (_, where, _) in enumerate(counts)]
    line = lambda of, name, rows, bad, example: F.struct(F.lit(of).alias("table"), F.lit(name).alias("constraint"), rows.alias("rows"), bad.cast("long").alias("bad"), example.cast("string").alias("example"))
    lines = [line(table, r.name, F.col("n"), F.col(f"b{k}"), F.col(f"e{k}")) for k, r in enumerate(rules)]
    lines += [line(name[0], name[1], F.col(f"c{k}"), F.col(f"c{k}") * sign, F.lit(None)) for k, (name, _, sign) in enumerate(counts)]
    return df.agg(*sums).select(F.explode(F.array(*lines)).alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in PART])


def _few(groups: DataFrame, table: str, name: str) -> list[DataFrame]:
    """(k, n, bad): their sums, and the smallest keys of bad groups, which every task cuts to EXAMPLES before they meet."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    some = groups.filter("bad > 0").orderBy("k").limit(EXAMPLES)
    return [_part(total, table, name, F.col("n"), F.col("bad"), F.lit(None)), _part(some, table, name, F.lit(0), F.lit(0), F.col("k"))]


def _parts(tables: Mapping[str, DataFrame], constraints: list[Constraint]) -> list[DataFrame]:
    out = []
    for table in dict.fromkeys(t for c in constraints if isinstance(c, (Holds, SameCount)) for t in ((c.table,) if isinstance(c, Holds) else (c.table, c.other))):
        rules = [c for c in constraints if isinstance(c, Holds) and c.table == table]
        same = [c for c in constraints if isinstance(c, SameCount)]
        counts = [((c.table, c.name), c.where, 1) for c in same if c.table == table] + [((c.table, c.name), c.other_where, -1) for c in same if c.other == table]
        out.append(_scan(table, tables[table], rules, counts))
    for c in constraints:
        if isinstance(c, Unique):  # rows beyond the first of their key are bad, and every row without one
            groups = tables[c.table].groupBy(F.col(c.key).alias("k")).agg(F.count("*").alias("n"))
            out += _few(groups.withColumn("bad", F.when(F.col("k").isNull(), F.col("n")).otherwise(F.col("n") - 1)), c.table, c.name)
        elif isinstance(c, Refers):  # values are counted before they meet the keys, so one that most rows hold is one row
            values = tables[c.table].filter(c.where).filter(F.col(c.column).isNotNull()).groupBy(F.col(c.column).alias("k")).agg(F.count("*").alias("n"))
            keys = tables[c.to].select(F.col(c.key).alias("there")).filter("there is not null").distinct()
            known = values.join(keys, F.col("k") == F.col("there"), "left")
            out += _few(known.select("k", "n", F.when(F.col("there").isNull(), F.col("n")).otherwise(0).alias("bad")), c.table, c.name)
    return out


def check(tables: Mapping[str, DataFrame], constraints: Iterable[Constraint]) -> DataFrame:
    """table, constraint, rows, bad, examples: a line a constraint, bad being 0 where it holds."""
    parts = _parts(tables, list(constraints))
    if not parts:
        raise ValueError("no constraints")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("table", "constraint").agg(F.sum("rows").alias("rows"), F.abs(F.sum("bad")).alias("bad"), F.array_sort(F.collect_set("example")).alias("examples"))


def observed(df: DataFrame, rules: Iterable[Holds]) -> tuple[DataFrame, Observation]:
    """df with counters of broken conditions: when a pass over it has ended, Observation.get has rows and one number a rule."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(F.expr(r.condition), F.lit(False))).alias(r.name) for r in rules]), seen


def damages(found: DataFrame, at: int) -> DataFrame:
    """Broken constraints as rows for the ledger of damage (repair.recorded): kind, item, sig, state, at. What is told is the table, the constraint and
    how much is bad; the same finding is told once."""
    return found.filter("bad > 0").select(F.lit("constraint").alias("kind"), F.concat_ws(": ", "table", "constraint").alias("item"), F.col("bad").cast("string").alias("sig"), F.lit("broken").alias("state"), F.lit(at).cast("long").alias("at"))


#: What holds for every published archive (plans/model.py).
ARCHIVE: tuple[Constraint, ...] = (
    Unique("posts", "id"), Unique("comments", "id"), Unique("entries", "id"), Unique("comment_loc", "id"),
    Holds("comments", "replies are below their root", "reply_to IS NULL OR reply_to = 0 OR level > 0"),
    SameCount("own comments are placed on pages", "comments", "feed", "comment_loc"),
    SameCount("posts are searchable", "posts", "true", "search_docs", "kind = 'p'"),
    SameCount("own comments are searchable", "comments", "feed", "search_docs", "kind = 'c'"),
    SameCount("other comments are searchable", "comments", "NOT feed", "search_docs", "kind = 'o'"),
    Refers("comment_loc", "id", "comments", "id"), Refers("comments", "entry_id", "entries", "id"), Refers("post_blocks", "post_id", "posts", "id"), Refers("month_groups", "entry_id", "entries", "id"),
)
