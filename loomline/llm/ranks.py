"""Places of rows within groups of any size: rows are dealt by range of (group, order), numbered within a range, and offset by the ranges before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from loomline.llm.common import stored


def ranked(rows: DataFrame, group: Column, order: list[Column], name: str) -> DataFrame:
    """rows with __pos, from 1 within each group (a text that is never null) in the order; rows equal in it are told apart at random. The result is
    stored: a group may lie in many ranges, and lines for offsets are one a range."""
    by = [F.col("__g"), *order, F.col("__u")]
    dealt = rows.withColumn("__g", group).withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__u")
    schema = StructType([*dealt.schema.fields]).add("__part", IntegerType()).add("__pos", LongType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            g = batch["__g"]
            first = np.flatnonzero(np.r_[True, pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)])
            pos = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) + 1
            if g[0].as_py() == last:
                pos[: first[1] if len(first) > 1 else n] += count
            last, count = g[n - 1].as_py(), int(pos[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos.astype(np.int64))], schema.names)

    found = stored(dealt.mapInArrow(number, schema), name)
    ends = found.groupBy("__part").agg(F.min("__g").alias("first"), F.max(F.struct("__g", "__pos")).alias("last")).orderBy("__part").collect()  # a line a range
    before, offsets = (None, 0), []
    for r in ends:
        if before[0] == r["first"]:
            offsets.append((r["__part"], r["first"], before[1]))
        before = (r["last"]["__g"], r["last"]["__pos"] + (before[1] if before[0] == r["last"]["__g"] else 0))
    if not offsets:
        return found.drop("__part", "__g")
    lines = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__o_part int, __o_g string, __off long"))
    moved = found.join(lines, (F.col("__part") == F.col("__o_part")) & (F.col("__g") == F.col("__o_g")), "left")
    return moved.withColumn("__pos", F.col("__pos") + F.coalesce("__off", F.lit(0))).select(*rows.columns, "__pos")
