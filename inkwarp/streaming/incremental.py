"""Streams: files not seen yet, running sums of a regression, counts in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(spark: SparkSession, folder: str, schema: str, keys: list[str], per_trigger: int = 100) -> DataFrame:
    """A stream of a folder's Parquet rows, each key once; files are read as they come, some a trigger (ST-01, ST-02, ST-04)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder).dropDuplicates(keys)


def regression_sums(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Running sums of a regression of y on x; a row of weight -1 takes one away (ST-03). Works on streams in complete mode."""
    w = F.col("weight")
    return rows.groupBy().agg(F.sum(w).alias("n"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col(y)).alias("sxy"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, kind, n): counts in windows, with a watermark; an extension, the survey has no windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
