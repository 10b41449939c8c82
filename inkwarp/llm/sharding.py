"""Sharding by rendezvous hashing over weighted shards.

For each record and shard, u in (0, 1) comes from the md5 of key and shard; the record goes to the shard of the largest
-weight / ln(u). A shard gets its weight's share of the records. A score depends on its own record and shard only, so when a
shard comes, only records that it wins move, and when one goes, only its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.session import table

NAME = "op4_sharding"
#: Shards by name, with weights: four of double size.
SHARDS = {f"shard-{i:02d}": 2.0 if i % 4 == 0 else 1.0 for i in range(16)}
_DIGITS = 13  # hexadecimal digits of the md5, 52 bits: exact in a double


def key_of(docs: DataFrame):
    """The stable key of a record: its id, or the md5 of its text where it has none; "" where it has neither."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(docs["text"].cast("string")), F.lit(""))


def assign(docs: DataFrame, shards: dict[str, float] = SHARDS) -> DataFrame:
    """(doc_id, shard) of each row.

    Rows with one key go to one shard. Shards of weight 0 get nothing; negative weights are an error. Of equal scores the
    shard of greatest name wins. Other columns are ignored; an empty table gives no rows.
    """
    if not shards or min(shards.values()) < 0 or not max(shards.values()) > 0:
        raise ValueError("at least one shard with a positive weight is needed, and none with a negative one")
    def score(name: str, weight: float):
        u = (F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit(f":{name}"))), 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        return F.struct((-F.lit(float(weight)) / F.ln(u)).alias("score"), F.lit(name).alias("shard"))

    best = F.greatest(*(score(n, w) for n, w in shards.items() if w > 0)) if sum(w > 0 for w in shards.values()) > 1 else score(*next((n, w) for n, w in shards.items() if w > 0))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key_of(docs).alias("key")).select("doc_id", best["shard"].alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{n}', {w})" for n, w in SHARDS.items())
SQL = f"""
WITH s(shard, weight) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS key FROM documents),
x AS (SELECT r, doc_id, shard, -weight / ln((('0x' || substr(md5(key || ':' || shard), 1, {_DIGITS}))::BIGINT + 0.5) / {16**_DIGITS}.0::DOUBLE) AS score FROM d, s)
SELECT doc_id, arg_max(shard, score) AS shard FROM x GROUP BY r, doc_id
"""
