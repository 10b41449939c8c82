"""Exact top-k search (BM25) with block-at-a-time pruning.

Documents lie in blocks of BLOCK rows. A block's forward index has, document by document, the query terms in it with their
impacts, and a maximum for each term. For every query, a task orders its blocks by summed term maxima and scores them through their
forward indexes, until the next bound falls below the k-th best score so far. Document frequencies and lengths are
counted over all documents first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.llm.words import column_words, slices
from inkwarp.session import settle, table

NAME = "op5_search"
K, BLOCK, K1, B = 10, 128, 1.2, 0.75
#: Queries that one pass over the documents answers; more take further passes.
QUERIES = 2_000
#: Scores are compared to six decimals, so that the order of additions doesn't matter; ties go to the least id.
_TICK = 1e-6


def _counts(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the terms (sorted hashes) in each text, in order of rows, and the texts' lengths in words."""
    hashes, rows = column_words(column)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[at] == hashes
    key, count = np.unique(rows[hit] * np.int64(len(terms)) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), count, np.bincount(rows, minlength=len(column))


def _statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents, words, document frequency of each term) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(terms), np.int64)
        for batch in slices(batches, 0):
            _, term, _, length = _counts(batch.column(0), terms)
            n, total, df = n + len(length), total + int(length.sum()), df + np.bincount(term, minlength=len(terms))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there], pa.int32()), pa.array([n, total, *df[there]], pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    by = dict(zip(found["term"], found["n"], strict=True))
    df = np.zeros(len(terms), np.int64)
    for t, n in by.items():
        if t >= 0:
            df[t] = n
    return by.get(-2, 0), by.get(-1, 0), df


class Block:
    """The forward index of some documents: ids, and for each entry its document, term and impact, in order of documents."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.doc, self.term, self.impact = ids, doc, term, impact
        self.terms, back = np.unique(term, return_inverse=True)
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, back, impact)


def best(blocks: list[Block], weights: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score): each query's k best documents of the blocks, with scores above 0. weights: terms of each query, and how often."""
    bounds = np.zeros((len(blocks), len(weights)))
    # queries and weights by term: of a block, only its own terms' are added up
    term, of, weight = (np.concatenate([np.zeros(0, k), *x]) for x, k in (([t for t, _ in weights], np.int64), ([np.full(len(t), q) for q, (t, _) in enumerate(weights)], np.int64), ([w for _, w in weights], float)))
    order = np.argsort(term, kind="stable")
    of, weight, at = of[order], weight[order], np.searchsorted(term[order], np.arange(n_terms + 1))
    for i, b in enumerate(blocks):
        size = at[b.terms + 1] - at[b.terms]
        own = np.repeat(at[b.terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bounds[i] = np.bincount(of[own], weight[own] * np.repeat(b.most, size), len(weights))
    found = []
    own = np.zeros(n_terms)
    for q, (t, w) in enumerate(weights):
        own[t] = w
        ids, scores, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        for i in np.argsort(-bounds[:, q], kind="stable"):
            bound = bounds[i, q] + _TICK
            if bounds[i, q] <= 0 or len(ids) >= k and bound < kth:
                break
            b = blocks[i]
            s = np.round(np.bincount(b.doc, own[b.term] * b.impact, len(b.ids)), 6)
            good = np.flatnonzero((s > 0) & (s >= kth))
            if len(good):
                ids, scores = np.concatenate([ids, b.ids[good]]), np.concatenate([scores, s[good]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                kth = scores[-1] if len(ids) >= k else 0.0
        found += [(q, int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
        own[t] = 0
    return found


def _pass(docs: DataFrame, some: list[tuple[int, np.ndarray]], k: int, block: int) -> DataFrame:
    """(item_id, doc_id, score) of candidates: each task's k best for the queries (id, word hashes)."""
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in some)]))
    if not len(terms):
        return docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score double")
    n, total, df = _statistics(docs, terms)
    average = max(total, 1) / max(n, 1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weights = []
    for _, h in some:
        t, w = np.unique(np.searchsorted(terms, h), return_counts=True)
        weights.append((t, w.astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = []
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy()
            row, term, count, length = _counts(batch.column(1), terms)
            impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[row] / average))
            cuts = np.searchsorted(row, np.arange(0, len(ids) + block, block))
            for i, low in enumerate(range(0, len(ids), block)):
                x, y = cuts[i], cuts[i + 1]
                if y > x:
                    blocks.append(Block(ids[low : low + block], (row[x:y] - low).astype(np.int32), term[x:y].astype(np.int32), impact[x:y].astype(np.float64)))
        rows = best(blocks, weights, len(terms), k)
        if rows:
            q, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([some[x][0] for x in q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id bigint, doc_id bigint, score double")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest BM25 score for every item (item_id, text), of score above 0.

    Words are as in the n-gram join, and a word that an item repeats counts as often. Equal scores (to six decimals) go by id.
    Documents without id or text don't count. Rows that repeat an id are documents of their own. Items without id are left
    out, and items without words or matches have no rows; rows that repeat an item are one query of all their
    words. Other columns are ignored. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    words = settle(rows.mapInArrow(_hashed, "item_id bigint, words binary"))
    passes = max(1, -(-words.select("item_id").distinct().count() // queries))
    found = None
    for i in range(passes):
        asked: dict[int, list[np.ndarray]] = {}
        for r in words.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).collect():  # about queries of them
            asked.setdefault(r["item_id"], []).append(np.frombuffer(r["words"], np.uint64))
        part = _pass(docs, [(x, np.concatenate(asked[x])) for x in sorted(asked)], k, block)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.select("item_id", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each item's words."""
    for batch in slices(batches, 1):
        hashes, row = column_words(batch.column(1))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["item_id", "words"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM w),
t AS (SELECT r, doc_id, len(w) AS length, unnest(w) AS term FROM w),
tf AS (SELECT r, doc_id, length, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, r, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * length / average))), 6) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= {K}
"""
