"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Calendar days and months are those of a fixed offset, never of a zone with summer time.
OFFSET = "+03:00"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer partitions than there are cores, such as one small file, are dealt to all cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Where intermediate tables and checkpoints go: spark.checkpoint.dir. Where none is set: a local folder, if the master is local."""
    import os
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "loomline-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a new folder of the shared one and read again, and the folder. Rounds of a loop take this and not checkpoint(): what
    Spark knows of the partitioning of a checkpointed frame grows with every join, and so does the time to plan."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored folder that no frame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
