"""Sources: raw JSON documents, JSON lines, damage-aware reading, packed blobs, SQLite files, paged dumps, file hashes."""

from __future__ import annotations

import gzip
import json
import sqlite3
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def documents(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON document a file (gzip or not): typed columns with a schema, else one VARIANT column doc."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).json(path) if schema else reader.option("singleVariantColumn", "doc").json(path)


def changed_since(spark: SparkSession, path: str, since: str, pattern: str = "*.json*") -> DataFrame:
    """path, modified and length of files below path that changed after since (YYYY-MM-DDTHH:mm:ss in the session's time zone). No file is opened."""
    reader = spark.read.format("binaryFile").option("modifiedAfter", since).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip or not; the file each row is from in _file, its year in _year (of a name such as 2026.jsonl.gz)."""
    rows = spark.read.schema(schema).json(path).withColumn("_file", F.input_file_name())
    return rows.withColumn("_year", F.regexp_extract("_file", r"(\d{4})\.jsonl", 1).try_cast("int"))


_READ = StructType([StructField("status", StringType()), StructField("doc", StringType())])


def _opened(data: bytes | None) -> dict:
    if data is None:
        return {"status": "missing", "doc": None}
    try:
        raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
        json.loads(raw)
        return {"status": "ok", "doc": raw.decode()}
    except (OSError, EOFError, ValueError, zlib.error):
        return {"status": "damaged", "doc": None}


@F.pandas_udf(_READ)
def opened(content: pd.Series) -> pd.DataFrame:
    """status (ok, damaged, missing) and text of gzipped JSON."""
    return pd.DataFrame([_opened(c) for c in content], columns=["status", "doc"])


def checked(spark: SparkSession, path: str) -> DataFrame:
    """path, status, doc of every file: damage is a row, never a silent loss."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", opened("content").alias("x")).select("path", "x.status", "x.doc")


@F.pandas_udf(StringType())
def unpacked(blob: pd.Series) -> pd.Series:
    """JSON text of a zlib blob; null if it is damaged."""

    def one(b: bytes | None) -> str | None:
        try:
            return zlib.decompress(b).decode()
        except (TypeError, zlib.error, UnicodeDecodeError):
            return None

    return pd.Series([one(b) for b in blob], dtype=object)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def archives(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """A table of all archives of a library (folders archive=<nick>), with the column archive: one scan."""
    return spark.read.schema(schema).option("basePath", root).parquet(f"{root}/archive=*/{name}")


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name): read in ranges of rowid, one for each of option parts. The file
    must be reachable from the executors."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        with _ro(self.options["path"]) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def _ro(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", 4))
        self.columns = schema.names

    def partitions(self) -> list[InputPartition]:
        with _ro(self.path) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with _ro(self.path) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value)


class PagedSource(DataSource):
    """spark.read.format("paged").option("path", folder): a dump of a paged feed, one JSON file {items, next} a page, from option first on until
    a page is empty or names no next one. Pages are found on the driver by their links and read by the executors."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options)


def _page(folder: str, name: str) -> dict:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        return json.load(f)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.first = options["path"], options.get("first", "0")

    def partitions(self) -> list[InputPartition]:
        out, name = [], self.first
        while name is not None and name not in out:
            page = _page(self.folder, name)
            if not page.get("items"):
                break
            out.append(name)
            name = page.get("next")
        return [InputPartition(n) for n in out] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            for item in _page(self.folder, partition.value)["items"]:
                yield partition.value, json.dumps(item, ensure_ascii=False)


def keyset_page(feed: DataFrame, after: tuple[int, int] | None, size: int = 30) -> DataFrame:
    """The next page of a feed, newest first, after (date, id)."""
    if after:
        feed = feed.filter((F.col("date") < after[0]) | ((F.col("date") == after[0]) & (F.col("id") < after[1])))
    return feed.orderBy(F.desc("date"), F.desc("id")).limit(size)


def register(spark: SparkSession) -> None:
    """Make the formats sqlite and paged known."""
    for source in (SqliteSource, PagedSource):
        spark.dataSource.register(source)


_PARTS = StructType([StructField("whole", BooleanType()), StructField("head", StringType()), StructField("items", ArrayType(StringType()))])


def _salvaged(data: bytes | None, name: str = "items") -> dict:
    """As much of a document {..., name: [...]} as can be read: gzip up to where it breaks, then whole items up to where the text breaks."""
    unreadable = {"whole": False, "head": None, "items": []}
    if not data:
        return unreadable
    whole = True
    if data[:2] == b"\x1f\x8b":
        inflater, out = zlib.decompressobj(31), []
        try:
            for k in range(0, len(data), 4096):
                out.append(inflater.decompress(data[k : k + 4096]))
        except zlib.error:
            whole = False
        data, whole = b"".join(out), whole and inflater.eof
    text = data.decode("utf-8", "ignore")
    if whole:
        try:
            doc = json.loads(text)
            if isinstance(doc, dict) and isinstance(doc.get(name, []), list):
                items = doc.pop(name, [])
                dump = lambda x: json.dumps(x, ensure_ascii=False)
                return {"whole": True, "head": dump(doc), "items": [dump(x) for x in items if isinstance(x, dict)]}
        except ValueError:
            pass
    head, found, rest = text.partition(f'"{name}"')
    at = rest.find("[") + 1
    if not found or not at:
        return unreadable
    decoder, items = json.JSONDecoder(), []
    try:
        while True:
            while rest[at : at + 1] in (" ", "\n", "\t", "\r", ","):
                at += 1
            item, at = decoder.raw_decode(rest, at)
            items.append(json.dumps(item, ensure_ascii=False))
    except ValueError:
        head = head.rstrip().rstrip(",")
        return {"whole": False, "head": head + "}" if head.startswith("{") else None, "items": items}


def salvaged(content, name: str = "items"):
    """whole, head (the document without its items, as JSON) and items (each as JSON) of a document that may be cut short."""

    @F.pandas_udf(_PARTS)
    def read(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_salvaged(None if d is None else bytes(d), name) for d in data], columns=["whole", "head", "items"])

    return read(content)


def tree_copies(spark: SparkSession, folders: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Copies of trees in folders, each with the rank of its source: files <tree>.json.gz with fetchedAt and items -> (copies, nodes) for repair.rebuilt. A damaged file
    gives the items before its damage."""
    from functools import reduce

    from loomline.operators.canonical import signed

    one = lambda rank, path: spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path).select(F.regexp_extract("path", r"(\d+)\.json", 1).try_cast("long").alias("tree"), F.lit(rank).alias("source"), salvaged("content").alias("x"))
    files = reduce(DataFrame.unionByName, [one(rank, path) for rank, path in folders.items()])
    fetched = F.coalesce(F.get_json_object("x.head", "$.fetchedAt").try_cast("long"), F.lit(0))
    copies = files.select("tree", "source", fetched.alias("fetched"), F.coalesce("x.whole", F.lit(False)).alias("whole"))
    get = lambda path: F.get_json_object("body", path).try_cast("long")
    items = files.select("tree", "source", F.posexplode("x.items").alias("pos", "body")).withColumn("key", F.concat_ws("/", "tree", "source", "pos"))
    nodes = items.select("key", "tree", "source", get("$.id").alias("id"), get("$.replyTo").alias("parent"), get("$.date").alias("date"), "body").filter("id is not null")
    return copies, nodes.join(signed(items, "key", "comment", "body"), "key").drop("key")
