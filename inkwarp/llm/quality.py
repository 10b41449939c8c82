"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labelled documents (a bounded sample, see MOST_LABELLED) are described by FEATURES and binned by quantiles;
trees grow level by level from gradient histograms of the logistic loss. The forest is flattened into five
arrays, and documents go down all trees at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.llm.words import buffers, mix, slices, words
from inkwarp.session import table

NAME = "op2_quality"
SQL = None
#: The classifier is fitted on at most about this many labelled documents, those of least hash.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT = 40, 4, 64, 0.2, 1.0
#: Documents that score less are rejected. Below a half, as a good document lost costs more than a bad one kept.
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _BREAK, _BEYOND = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _SPACE, _BREAK, _BEYOND
_SIGNS = b"!|$&%#*"
FEATURES = ("log_words", "word_bytes", "long_word", "upper", "digit", "space", "breaks", "beyond_ascii", "stops", *(f"sign_{i}" for i in range(len(_SIGNS))), "other_signs", "distinct", "pairs_distinct", "repeats", "words_a_break")


def features(column: pa.Array) -> np.ndarray:
    """FEATURES of each text, all 0 for a text without words; shares are of bytes, or of words where they concern words."""
    data, at = buffers(column)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    kind = _KIND[data]

    def total(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return s[at[1:]] - s[at[:-1]]

    size = np.maximum(np.diff(at), 1)
    folded = data.copy()
    folded[kind == _UPPER] += 32
    hashes, first, end, row = words(folded, at)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    length = end - first
    signs = [total(data == s) for s in _SIGNS]
    stops = total((data == 46) | (data == 44))
    shares = [total(kind == k) / size for k in (_UPPER, _DIGIT, _SPACE, _BREAK, _BEYOND)]
    other = total(kind == 0) - sum(signs) - stops
    begin = np.cumsum(count) - count
    longest = np.zeros(n)
    filled = np.flatnonzero(count)
    if len(filled):
        longest[filled] = np.maximum.reduceat(length, begin[filled])

    def distinct(h: np.ndarray, r: np.ndarray) -> np.ndarray:
        order = np.argsort(mix(h ^ mix(r.astype(np.uint64))), kind="stable")
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    inner = row[1:] == row[:-1]
    pair, of = (mix(hashes[:-1]) ^ hashes[1:])[inner], row[1:][inner]
    same = np.bincount(row[1:][inner & (hashes[1:] == hashes[:-1])], minlength=n)
    few = np.maximum(some - 1, 1)
    columns = [np.log1p(count), np.bincount(row, length, n) / some, longest, *shares, stops / size, *(s / size for s in signs), other / size, distinct(hashes, row) / some, distinct(pair, of) / few, same / few, count / (total(kind == _BREAK) + 1)]
    out[:] = np.stack(columns, axis=1)
    out[count == 0] = 0
    return out


@dataclass
class Forest:
    """All trees in one set of arrays: at node i, x[feature[i]] <= cut[i] goes to left[i], else to right[i]; leaves lead to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-self.base - self.value[node].sum(axis=1)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosted trees for labels 0 and 1."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    f = np.full(n, base)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        at, level = np.full(n, roots[-1]), [roots[-1]]
        for d in range(depth + 1):
            own = np.full(len(nodes), -1)
            own[level] = np.arange(len(level))
            place = own[at]
            live = place >= 0
            k = len(level)
            sums = np.stack([np.bincount(place[live], w[live], k) for w in (g, h)])
            for i, node in enumerate(level):
                nodes[node][4] = rate * sums[0, i] / (sums[1, i] + LEAST_WEIGHT)
            if d == depth:
                break
            best = [(1e-6, -1, 0)] * k
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key, size = place[live] * bins + binned[live, j], k * bins
                hg, hh = (np.bincount(key, w[live], size).reshape(k, bins).cumsum(axis=1) for w in (g, h))
                rg, rh = sums[0][:, None] - hg, sums[1][:, None] - hh
                gain = hg**2 / (hh + LEAST_WEIGHT) + rg**2 / (rh + LEAST_WEIGHT) - (sums[0] ** 2 / (sums[1] + LEAST_WEIGHT))[:, None]
                gain[(hh < LEAST_WEIGHT) | (rh < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(cuts[j])]
                b = gain.argmax(axis=1)
                best = [(gain[i, b[i]], j, b[i]) if gain[i, b[i]] > best[i][0] else best[i] for i in range(k)]
            after = []
            for node, (_, j, b) in zip(level, best, strict=True):
                if j < 0:
                    continue
                left = len(nodes)
                nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]]
                nodes[node][:4] = [j, cuts[j][b], left, left + 1]
                inside = at == node
                at = np.where(inside, np.where(binned[:, j] <= b, left, left + 1), at)
                after += [left, left + 1]
            level = after
            if not level:
                break
        f += np.array([v[4] for v in nodes])[at]
    columns = list(zip(*nodes, strict=True))
    return Forest(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Forest | None:
    """Fits the classifier on labelled documents; None where there are none of either label.

    Labels other than 0 and 1, and those of unknown ids, don't count. The sample is that of least hash of the id.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(most / n * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tobytes()[i * x.shape[1] * 8 : (i + 1) * x.shape[1] * 8] for i in range(len(x)))], ["quality", "x"])

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("quality", "text").mapInArrow(run, "quality int, x binary").toArrow()
    if not found.num_rows:
        return None
    y = found.column("quality").to_numpy()
    x = np.frombuffer(b"".join(found.column("x").to_pylist())).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order].astype(float)) if 0 < y.sum() < len(y) else None


def _scores(column: pa.Array, forest: Forest | None) -> np.ndarray:
    x = features(column)
    return np.where(x[:, 0] == 0, 0.0, forest.score(x) if forest else 1.0)


def score(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, keep) of each row.

    A text without words (null, empty, signs only) scores 0. Without a classifier all others score 1. Rows that repeat an
    id, and those without id, are scored one by one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            s = _scores(batch.column(1), forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(s, 6)), pa.array(s >= threshold)], ["doc_id", "score", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, keep boolean")


def kept(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(_scores(batch.column(at).cast(pa.string()), forest) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
