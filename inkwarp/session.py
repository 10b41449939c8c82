"""Session helpers: reading tables and cutting lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where none is set, a local session gets a temporary one; on a cluster that is an error, as executors
    don't share a machine's own folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkwarp-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written to the shared folder in Parquet and read from there, and where it is: for wide rows, of which each use reads its columns only. deleted() takes it away."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores where its source has fewer (a file of one row group is one task); else as it is.

    For work on rows alone that is dearer than moving them once. Only plans are asked, no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scattered(df: DataFrame, key: str, rows: int = 10_000) -> DataFrame:
    """df in parts of about so many rows by a hash of key, one a core at least, however its files are cut.

    For small rows that work far dearer than moving them follows. A file of one row group is the work of one task even where the
    engine cuts the file into as many splits as there are cores, so partitions aren't asked. Of a file's footers rows are counted.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows)), key)
