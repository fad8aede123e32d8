"""What a listing of posts tells beside their downloads: live counters, posts no longer listed, references, the catalogue of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The objects of a post that change without an edit.
LIVE = "counters reactions donations likes".split()


def live_stats(raw: Column) -> Column:
    """Of a post as JSON: each LIVE object as JSON text (null if it is none), and the number of gifts (null if they are no list)."""
    v = F.try_parse_json(raw)

    def of(name: str, kind: str) -> Column:
        found = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(found).startswith(kind), found)

    gifts = F.size(F.try_variant_get(of("gifts", "ARRAY"), "$", "array<variant>"))
    return F.struct(*[F.to_json(of(n, "OBJECT")).alias(n) for n in LIVE], F.when(of("gifts", "ARRAY").isNotNull(), gifts).cast("long").alias("gifts"))


def overlaid(base: Column, over: Column) -> Column:
    """A map with the entries of another put over its own; where one is null, the other."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.coalesce(F.map_concat(kept, over), base, over)


def unlisted(posts: DataFrame, listed_at: str, name: str = "unlisted") -> DataFrame:
    """posts with a flag: listed once, but not in the latest listing. Never listed is false."""
    latest = posts.agg(F.max(listed_at)).scalar()
    return posts.withColumn(name, F.coalesce(F.col(listed_at) < latest, F.lit(False)))


def reference(id: Column, url: Column, title: Column, date: Column, *names: Column, base: str = "") -> Column:
    """The post that a repost or embed points to; its author is the first name that is not empty, its URL the given one or base and id."""
    author = F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))
    made = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(base), id.cast("string")), F.lit(""))
    return F.struct(id.alias("id"), made.alias("url"), title.alias("title"), author.alias("author"), date.alias("date"))


def as_answer(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Comments of the read model (id, date, author, reply_to, level, text, removed, edited, likes) in the shape of the site's answers. users
    (id, name, nickname, uri): of repeated ids one row; an unknown author keeps the id."""
    u = users.groupBy(F.col("id").alias("__uid")).agg(F.min_by(F.struct("name", "nickname", "uri"), F.struct(*[F.coalesce(c, F.lit("")) for c in ("name", "nickname", "uri")])).alias("__u"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    author = F.struct(F.col("author").alias("id"), *[F.col(f"__u.{c}").alias(c) for c in ("name", "nickname", "uri")])
    return comments.join(u, F.col("author") == F.col("__uid"), "left").select(
        "id", "date", author.alias("author"), zero("reply_to").alias("replyTo"), zero("level").alias("level"), F.coalesce("text", F.lit("")).alias("text"),
        no("removed").alias("isRemoved"), no("edited").alias("isEdited"), F.struct(zero("likes").alias("counterLikes")).alias("likes"),
    )


def catalogue(kinds: DataFrame, choice: str | None = None, level: str = "level", used: str = "n") -> DataFrame:
    """Kinds of blocks: all, those in use ("used"), or those of one level."""
    if not choice:
        return kinds
    return kinds.filter(F.col(used) > 0) if choice == "used" else kinds.filter(F.col(level) == choice)


def accumulated(known: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A catalogue with what a fresh listing says: its rows win, and known rows that it lacks stay, with retired set. Both have one row a key
    and the same columns; a null key meets a null key."""
    rest = [c for c in known.columns if c not in (key, "retired")]
    old = known.select(F.col(key).alias("__k"), F.struct(*rest).alias("__o"), F.lit(True).alias("__was"))
    new = fresh.select(F.col(key).alias("__n"), F.struct(*rest).alias("__f"), F.lit(True).alias("__is"))
    both = old.join(new, F.col("__k").eqNullSafe(F.col("__n")), "full_outer")
    row = F.when(F.col("__is"), F.col("__f")).otherwise(F.col("__o"))
    named = F.when(F.col("__is"), F.col("__n")).otherwise(F.col("__k"))
    return both.select(named.alias(key), row.alias("__r"), F.col("__is").isNull().alias("retired")).select(key, *[F.col("__r")[c].alias(c) for c in rest], "retired")
