"""The store of media: references by key, blobs by content, who uses what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """refs: key, sha256, status; blobs: sha256, size, mime, path -> key, sha256, path, size, mime, missing: where the file of a key is, or that upstream no longer
    has it. Keys that are still to be fetched, and those whose file is nowhere, are left out."""
    known = refs.filter(F.col("status").isin("done", "missing")).join(blobs, "sha256", "left")
    gone = F.col("status") == "missing"
    of = lambda c: F.when(~gone, F.col(c)).alias(c)
    return known.filter(gone | F.col("path").isNotNull()).select("key", of("sha256"), F.when(~gone, F.concat(F.lit("media/"), "path")).alias("path"), of("size"), of("mime"), gone.alias("missing"))


def owners(uses: DataFrame) -> DataFrame:
    """uses: key, owner -> key, owners: sorted, each once."""
    return uses.distinct().groupBy("key").agg(F.array_sort(F.collect_list("owner")).alias("owners"))


def usage(uses: DataFrame, found: DataFrame) -> DataFrame:
    """uses: key, archive; found: what index() gave -> a line an archive: files and bytes, each content once."""
    held = uses.join(found.filter("not missing").select("key", "sha256", "size"), "key").select("archive", "sha256", "size").distinct()
    return held.groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def others(rows: DataFrame, library: DataFrame, own: int, uid: str = "author") -> DataFrame:
    """library: uid, name (a line an archive) -> rows with other: the archive of the library, but for one's own, whose owner a row is by; null else."""
    names = library.filter(F.col("uid") != own).groupBy(F.col("uid").alias("__uid")).agg(F.min("name").alias("other"))
    return rows.join(names, F.col(uid) == F.col("__uid"), "left").drop("__uid")
