"""Counts, rankings, pivots, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.functions.text import journal_key, journals_match
from inkwarp.session import settle

#: Letters by which names of journals meet.
KEY = 4


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep, term) of each run of ASCII letters in lower case (KP-01)."""
    return docs.select("doc_id", *keep, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter("term <> ''")


def postings(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep, term, tf)."""
    return tokens(docs, *keep).groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def occurrences(rows: DataFrame, column: str, separator: str = r";\s*") -> DataFrame:
    """(term, n): occurrences of the items of a list column, quotes stripped (AG-01)."""
    items = rows.select(F.explode(F.split(column, separator)).alias("x")).select(F.regexp_replace("x", '^"|"$', "").alias("term"))
    return items.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


def document_frequency(posting: DataFrame, low: int = 2, high: int = 30_000) -> DataFrame:
    """(term, df) of terms in low to high documents; a posting has a document and term once (AG-07, PF-07)."""
    return posting.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df").between(low, high))


def weighted_order(rows: DataFrame, key: str, item: str, position: str) -> DataFrame:
    """(key, items): each key's different items by the sum of 1 / position², joined by "; " (AG-03)."""
    w = rows.groupBy(key, item).agg(F.round(F.sum(1.0 / (F.col(position) * F.col(position))), 9).alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col(item).alias("item"))))
    return w.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["item"]), "; ").alias("items"))


def breakdown(rows: DataFrame, dimensions: list[str], least: int = 1) -> DataFrame:
    """(dimension, value, n) for each dimension at once, of least rows or more (AG-06, AG-15, PF-12)."""
    sets = [(d,) for d in dimensions]
    counted = rows.groupingSets([[F.col(d)] for d, in sets], *map(F.col, dimensions)).agg(F.count("*").alias("n"), F.grouping_id(*dimensions).alias("g"))
    every = (1 << len(dimensions)) - 1
    at = lambda i: F.col("g") == every ^ (1 << (len(dimensions) - 1 - i))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        name, value = F.when(at(i), F.lit(d)).otherwise(name), F.when(at(i), F.col(d).cast("string")).otherwise(value)
    return counted.filter(F.col("n") >= least).select(name.alias("dimension"), value.alias("value"), "n")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two (term, df): terms of the right only have 0 on the left, those of the left only null on the right (JN-05)."""
    a, b = left.select("term", F.col("df").alias("left_df")), right.select("term", F.col("df").alias("right_df"))
    return a.join(b, "term", "full").select("term", F.coalesce("left_df", F.lit(0)).alias("left_df"), "right_df")


def compared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side (both, left, right) of two sets (JN-06, JN-07, SO-03)."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key (PF-03)."""
    return rows.withColumn("first_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("first_row = 1").drop("first_row")


def report(rows: DataFrame, year: str, item: str, order: str, field: str, n: int) -> DataFrame:
    """A row a year, a column for each of the n first items of the last year (greatest order, then name): their field (AG-05, JN-09).

    All years of rows are there. The n items are collected, as they are columns.
    """
    last = rows.agg(F.max(year)).first()[0]
    top = [r[0] for r in rows.filter(F.col(year) == F.lit(last)).orderBy(F.desc(order), item).limit(n).select(item).collect()]
    return rows.filter(F.col(item).isin(top)).groupBy(year).pivot(item, top).agg(F.first(field)) if top else rows.select(year).distinct()


def matched_names(short: DataFrame, full: DataFrame) -> DataFrame:
    """(short, full): abbreviations of journals and the names that they can stand for (JN-14, TX-27).

    The first word that counts of the abbreviation must begin that of the name, so they meet by the first letters, up to
    KEY of them; the walk along all words is made for pairs that pass.
    """
    a = short.select("short", journal_key(F.col("short")).alias("word")).filter("word <> ''").withColumn("key", F.substring("word", 1, KEY))
    b = full.select("full", journal_key(F.col("full")).alias("first")).filter("first <> ''").withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("first"))), lambda i: F.substring(F.col("first"), F.lit(1), i))))
    return a.join(b, "key").filter(F.startswith("first", "word")).filter(journals_match("short", "full")).select("short", "full")


def mapped(rows: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a map (key, ...), null for keys that it lacks (JN-13). The engine broadcasts a map that is small."""
    return rows.join(fields, key, "left")


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """A dimension: different values, not null, numbered in order (JN-03, JN-04). Its rows are few; they are ranked on one task."""
    return values.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)))


def running_group(start: Column, order: Window) -> Column:
    """Rows from one start to the next get one number (TX-09 to TX-12, TX-16)."""
    return F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))


def size_buckets(rows: DataFrame, key: str, size: Column, limit: int, range_size: int = 1 << 24) -> DataFrame:
    """(key, bucket): rows in order of key in files of about limit each (SK-15).

    The running sum goes over ranges of keys of about range_size each: sums of the ranges first, then inside each.
    """
    sized = rows.select(F.col(key), size.cast("bigint").alias("n"))
    ranges = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // range_size))
    spread = settle(sized.repartitionByRange(ranges, key).withColumn("part", F.spark_partition_id()))  # the ranges stay as they are
    total = spread.groupBy("part").agg(F.sum("n").alias("total"))
    before = total.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # a row a range
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(key)) + F.col("before")
    return spread.join(F.broadcast(before), "part").select(key, F.floor((upto - F.col("n")) / limit).cast("bigint").alias("bucket"))


def renumbered(rows: DataFrame, order: list[str], name: str, range_rows: int = 1 << 20) -> DataFrame:
    """rows with a running number from 1 in the order of columns, counted over ranges of them (SK-05)."""
    ranges = max(1, -(-rows.count() // range_rows))
    spread = settle(rows.repartitionByRange(ranges, *order).withColumn("part_", F.spark_partition_id()))
    before = spread.groupBy("part_").count().select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return spread.withColumn(name, own).join(F.broadcast(before), "part_").withColumn(name, (F.col(name) + F.col("before_")).cast("bigint")).drop("part_", "before_")
