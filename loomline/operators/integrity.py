"""Integrity: manifests against files, best surviving copies, content-addressed dedup, sampled checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.counting import prefix_budget


def reconcile(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """manifest: path, sha, size; disk: path, sha (null: unreadable), size; -> path, status: ok, missing, unreadable, damaged, stale (another content of
    another size, written anew) or adopted (not in the manifest yet)."""
    j = manifest.alias("m").join(disk.alias("d"), F.col("m.path") == F.col("d.path"), "full_outer")
    status = F.when(F.col("m.path").isNull(), F.when(F.col("d.sha").isNull(), "unreadable").otherwise("adopted")).when(F.col("d.path").isNull(), "missing").when(F.col("d.sha").isNull(), "unreadable")
    status = status.when(F.col("m.sha") == F.col("d.sha"), "ok").when(F.col("m.size") == F.col("d.size"), "damaged").otherwise("stale")
    return j.select(F.coalesce("m.path", "d.path").alias("path"), status.alias("status"))


def best_copies(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """wanted: item, sig; candidates: item, sig, date, source (rank, smaller is better), body -> the copy to restore: an exact one, else the latest,
    of the better source."""
    j = candidates.join(wanted.withColumnRenamed("sig", "want"), "item")
    exact = F.col("sig").eqNullSafe(F.col("want"))
    best = F.max_by(F.struct("sig", "date", "source", "body", exact.alias("exact")), F.struct(exact, "date", -F.col("source"), "body"))
    return j.groupBy("item").agg(best.alias("x")).select("item", "x.*")


def settle(repairs: DataFrame, fresh: DataFrame, tries: int = 3) -> DataFrame:
    """repairs: item, expected, attempts; fresh: item, sig -> outcome: exact, replaced, retry or lost."""
    j = repairs.join(fresh, "item", "left")
    outcome = F.when(F.col("sig") == F.col("expected"), "exact").when(F.col("sig").isNotNull(), "replaced").when(F.col("attempts") + 1 >= tries, "lost").otherwise("retry")
    return j.select("item", outcome.alias("outcome"), (F.col("attempts") + 1).alias("attempts"))


def by_content(blobs: DataFrame, data: str = "text", key: str = "doc_id") -> DataFrame:
    """key -> sha256 of its content and the smallest key that has it: one blob for equal bytes."""
    h = blobs.select(key, F.sha2(F.col(data).cast("binary"), 256).alias("sha256"))
    first = h.groupBy("sha256").agg(F.min(key).alias("stored_as"), F.count("*").alias("copies"))
    return h.join(first, "sha256")


def probe(new: DataFrame, stored: DataFrame, edge: int = 65_536) -> DataFrame:
    """Which stored blob a new one equals: same signature and size, same first and last bytes, and the same sha256 where these leave a middle.
    (key, same_as)."""
    middle = F.when(F.octet_length("data") > 2 * edge, F.sha2("data", 256)).otherwise("")
    ends = lambda d, k: d.select(F.col("key").alias(k), "sig", F.octet_length("data").alias("size"), F.xxhash64(F.expr(f"substring(data, 1, {edge})")).alias("a"), F.xxhash64(F.expr(f"substring(data, greatest(octet_length(data) - {edge - 1}, 1), {edge})")).alias("b"), middle.alias("m"))
    return ends(new, "key").join(ends(stored, "other"), ["sig", "size", "a", "b", "m"]).filter("key != other").groupBy("key").agg(F.min("other").alias("same_as"))


def due(blobs: DataFrame, budget: int) -> DataFrame:
    """Blobs to hash now: those checked longest ago until the bytes reach the budget, one at least."""
    return prefix_budget(blobs, [F.col("checked_at"), F.col("sha256")], "size", max(budget, 1))


def salvage(frames: list[DataFrame], key: str, valid) -> DataFrame:
    """Rows of damaged tables by precedence of the frames, those that are valid."""
    from loomline.operators.setlike import precedence_union

    return precedence_union([f.filter(valid) for f in frames], key)


def assert_clean(status: DataFrame) -> None:
    """Fails if any file is missing, unreadable or damaged: nothing is built from a damaged archive."""
    bad = {r["status"]: r["count"] for r in status.filter(F.col("status").isin("missing", "unreadable", "damaged")).groupBy("status").count().collect()}  # three lines at most
    if bad:
        raise ValueError(f"the archive needs repair first: {bad}")
