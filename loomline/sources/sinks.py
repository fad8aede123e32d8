"""Sinks: tables published by version, exports as JSON lines and Markdown, partitions rewritten where they changed."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

VIEW_FORMAT = 3


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def commit(spark: SparkSession, folder: str, number: int, state: dict) -> bool:
    """Put state down as the entry of a number in a log of a folder; false if another writer was first. An entry is written under a name of its own and renamed, so a
    reader sees all of it or none, and no entry is ever taken away."""
    (staged, fs), (final, _) = _path(spark, f"{folder}/.{number:012d}-{uuid.uuid4().hex}"), _path(spark, f"{folder}/{number:012d}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    done = not fs.exists(final) and fs.rename(staged, final)
    if not done:
        fs.delete(staged, False)
    return done


def committed(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and state of the last entry of a log; (0, {}) where there is none."""
    p, fs = _path(spark, folder)
    if not fs.exists(p):
        return 0, {}
    numbers = [int(n.partition(".")[0]) for f in fs.listStatus(p) if (n := f.getPath().getName()).endswith(".json") and not n.startswith(".")]
    if not numbers:
        return 0, {}
    entry, _ = _path(spark, f"{folder}/{max(numbers):012d}.json")
    opened = fs.open(entry)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(opened, spark._jvm.java.nio.charset.StandardCharsets.UTF_8)
    finally:
        opened.close()
    return max(numbers), json.loads(text)


def publish(frames: dict[str, DataFrame], root: str, version: str | None = None) -> str:
    """Write all tables to a new folder, then point to it by the next entry of a log: readers see the whole old state or the whole new one, after a crash in between as
    well. Returns the folder."""
    spark = next(iter(frames.values())).sparkSession
    name = version or uuid.uuid4().hex
    for table, df in frames.items():
        df.write.parquet(f"{root}/versions/{name}/{table}")
    while not commit(spark, f"{root}/current", committed(spark, f"{root}/current")[0] + 1, {"version": name, "view_format": VIEW_FORMAT}):
        pass
    return f"{root}/versions/{name}"


def current(spark: SparkSession, root: str) -> str | None:
    """The published folder; null where there is none, or one of another format."""
    _, state = committed(spark, f"{root}/current")
    return f"{root}/versions/{state['version']}" if state.get("view_format") == VIEW_FORMAT else None


def versions_of(spark: SparkSession, files: list[str]) -> str:
    """A hash of the names, sizes and times of files."""
    seen = hashlib.sha256()
    for f in sorted(files):
        p, fs = _path(spark, f)
        status = fs.getFileStatus(p)
        seen.update(f"{f}\n{status.getLen()}\n{status.getModificationTime()}\n".encode())
    return seen.hexdigest()


def sparse_lines(df: DataFrame, path: str) -> None:
    """JSON lines without keys that are null or empty."""
    kept = [F.when(F.length(F.col(c)) > 0, F.col(c)).alias(c) if t == "string" else F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*kept).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def full_lines(df: DataFrame, path: str) -> None:
    """JSON lines with all keys."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rewrite_years(df: DataFrame, path: str, year: str = "year") -> None:
    """Rewrite the yearly partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year).json(path, compression="gzip")


def markdown(df: DataFrame, path: str, name: str = "name") -> None:
    """df: name, front (map of strings), body -> one partition folder a name with its Markdown text."""
    front = F.array_join(F.transform(F.array_sort(F.map_entries("front")), lambda e: F.concat(e["key"], F.lit(": "), F.to_json(F.struct(e["value"].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["value"].alias("v")))) - 6))), "\n")
    df.select(F.col(name), F.concat(F.lit("---\n"), front, F.lit("\n---\n\n"), "body").alias("value")).write.mode("overwrite").partitionBy(name).text(path)


@F.pandas_udf(BinaryType())
def packed(raw: pd.Series) -> pd.Series:
    """JSON text as compact gzip without a time: the same object gives the same bytes."""
    compact = lambda r: json.dumps(json.loads(r), ensure_ascii=False, separators=(",", ":")).encode()
    return pd.Series([None if r is None else gzip.compress(compact(r), 6, mtime=0) for r in raw], dtype=object)


def refreshed(mirror: DataFrame, source: DataFrame) -> DataFrame:
    """(path, sha) of the files that a mirror lacks or has with another content."""
    return source.join(mirror, ["path", "sha"], "left_anti")


def parts(text: DataFrame, budget: int = 30_000) -> DataFrame:
    """Long answers in parts at paragraph breaks: (id, part, text). Paragraphs of one answer are folded in order."""
    from loomline.operators.counting import greedy_pages

    paragraphs = text.select("id", F.posexplode(F.split("text", "\n\n")).alias("pos", "p")).withColumn("size", F.length("p") + 2)
    paged = greedy_pages(paragraphs.withColumn("pos", F.col("pos").cast("long")), "id", "pos", "size", budget)
    joined = paragraphs.withColumn("pos", F.col("pos").cast("long")).join(paged, ["id", "pos"])
    return joined.groupBy("id", F.col("page").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]), "\n\n").alias("text"))

