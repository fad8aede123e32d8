"""Derivations over documents with nested columns: reactions, covers, leads, levels, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reactions that count as negative unless others are set, and how far each kind of block is understood.
NEGATIVE = ("23", "5", "25", "39", "40", "41", "7", "28")
FULL = "text header list quote incut delimiter media video link osnovaEmbed code quiz person audio telegram".split()
PARTIAL = "special_button telegram_button rawhtml".split()
GENERIC = "tweet instagram tiktok yamusic spotify game number embed movie".split()


def money(v: Column) -> Column:
    """Whole and not negative; anything else is 0."""
    return F.greatest(F.lit(0), F.coalesce(F.try_to_number(v.cast("string"), F.lit("999999999999")).cast("long"), F.lit(0).cast("long")))


def reaction_pairs(counters: Column) -> Column:
    """array<struct<id,count>> -> (id, n) with n > 0, by falling n, else as they come; counts that are no whole numbers are left out."""
    numbered = F.transform(counters, lambda x, i: F.struct((-x["count"].try_cast("double")).cast("long").alias("o"), i.alias("i"), x["id"].alias("id"), x["count"].try_cast("double").cast("long").alias("n")))
    ordered = F.array_sort(F.filter(numbered, lambda x: x["n"] > 0))
    return F.transform(ordered, lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n")))


def reactions_total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def split_reactions(pairs: Column, negative: tuple = NEGATIVE) -> tuple[Column, Column]:
    """(positive, negative) totals."""
    bad = lambda x: x["id"].cast("string").isin(*negative)
    return reactions_total(F.filter(pairs, lambda x: ~bad(x))), reactions_total(F.filter(pairs, bad))


def block_level(kind: Column) -> Column:
    return F.when(kind.isin(*FULL), "full").when(kind.isin(*PARTIAL, *GENERIC), "generic").otherwise("unsupported")


def lead(texts: Column, width: int = 300) -> Column:
    """The first text that is not empty, cut with an ellipsis."""
    first = F.element_at(F.filter(texts, lambda x: F.trim(x) != ""), 1)
    return F.coalesce(F.when(F.length(first) > width, F.concat(F.left(first, F.lit(width)), F.lit("…"))).otherwise(first), F.lit(""))


def first_of(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def context_status(present: Column, needed: Column, fetched: Column, entry: Column) -> Column:
    """Whether a comment's context is there. present: in the fetched thread; needed: it answers something or is answered."""
    status = F.when(present, "ok").when(~needed, "not_needed").when(~fetched, "not_fetched").otherwise("missing")
    return F.when(entry.isNull(), "no_post").otherwise(status)


def media_signature(size: Column, *rest: Column) -> Column:
    """size|width|height|type|color|duration; null unless the size is a positive whole number, missing parts are empty."""
    return F.when(size.try_cast("long") > 0, F.concat_ws("|", size.cast("string"), *[F.coalesce(x.cast("string"), F.lit("")) for x in rest]))
