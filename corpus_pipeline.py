"""A training corpus from raw documents: quality, near duplicates, personal data, source mix, packing.

All stages take rows with nulls in any column, empty and very long texts, repeated rows, other columns of any names and empty
tables; what becomes of each is said stage by stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwarp.llm import jaccard, mixing, packing, pii, quality
from inkwarp.session import shared_folder, table

#: SQL can't express the boosted trees, the keyed surrogates, the knapsack or the packing.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    Documents without text or word go; repeated rows are judged one by one, alike. Where labels tell nothing (none that are 0 or 1
    on documents here) all with a word stay. Columns pass; an empty table stays empty.
    """
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least id.

    Of rows that repeat an id one stays, that of least text; rows without id or without words stay. Columns pass; an
    empty table stays empty.
    """
    return jaccard.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data and secrets.

    As many rows as came; null and empty texts stay so, and equal texts stay equal. Other columns pass; an empty table stays empty.
    """
    return pii.replaced(docs)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its share of the tokens.

    A null source is a source. Documents without tokens go. Of equally long ones those of least hash of the id stay; rows that
    repeat an id tie, those of least text stay first. Columns pass; an empty table stays empty.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    Documents without tokens have no row, longer ones than a pack several; repeated rows are packed one by one. An empty table
    gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mixing", balanced), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. Each result is written to the folder that executors share and read again; once the next is there it is deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
