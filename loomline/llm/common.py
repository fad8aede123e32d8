"""What several operators of this subpackage share: shared storage, skew-safe joins, row keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import discard, spread

#: Keys that hold at least this share of all rows are joined by broadcast; there can be no more than 1 / share of them.
HOT_SHARE = 1 / 512
#: Spark removes the shuffle files of a statement when it ends, instead of at some later collection of garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; documents of a small file are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set: a local folder, if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "loomline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are cut by rows alone; a thousand rows keep those of long texts small. A value set by the user stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Give memory that a Python worker has freed back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def releasing(run: Callable) -> Callable:
    """run, a function of batches, with release() after the last."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder as Parquet, partitioned by the given columns, and read again: compact, and columns are pruned on reading.
    The shuffle files of the write go as soon as the table is there, which replaces them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the files of a stored table, not partitioned by columns, that no frame reads any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        discard(df.sparkSession, folder)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Rows equal in id and text share a key; others differ but for 64-bit collisions."""
    return F.xxhash64(F.lit(17), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def skew_join(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, how: str = "left", merge: bool = False) -> DataFrame:
    """Join rows to groups, which has one line per key and the number of rows of it in weight. Keys that hold HOT_SHARE of all rows are
    broadcast (at most 1 / HOT_SHARE lines); the others are joined by shuffle, or if few as Spark chooses, which merge rules out. Null keys match
    null keys."""
    least = max(1, int(total * HOT_SHARE))
    hot = groups.filter(F.col(weight) >= least)
    cold = groups.filter(F.col(weight) < least).drop(weight)
    mark = f"__hot_{key}"
    marked = rows.join(
        F.broadcast(hot.select(F.col(key).alias(mark), F.lit(True).alias("__is_hot"), *[F.col(c).alias(f"__h_{c}") for c in cold.columns if c != key])),
        F.col(key).eqNullSafe(F.col(mark)),
        "left",
    ).drop(mark)
    added = [c for c in cold.columns if c != key]
    of_hot = marked.filter("__is_hot").select(*rows.columns, *[F.col(f"__h_{c}").alias(c) for c in added])
    rest = marked.filter(F.col("__is_hot").isNull()).select(*rows.columns)
    there = cold.withColumnRenamed(key, mark)
    there = there.hint("merge") if merge else there
    of_rest = rest.join(there, F.col(key).eqNullSafe(F.col(mark)), how).select(*rows.columns, *added)
    return of_hot.unionByName(of_rest)
