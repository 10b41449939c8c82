"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (SAMPLE); every row is then in the leaf that greedy descent finds, so leaves cover the
whole table. A query goes through the tree with a priority queue: the nearest unopened node is next, an inner
node adds its children, a leaf is a visit. How many leaves to visit is calibrated: for about PROBES queries the true neighbours are found
by brute force over the whole table, and visits are widened until TARGET of these lie in visited leaves. Rows of each leaf are
counted over the whole table; neighbouring leaves form parts of about PART rows, and a leaf with more (many equal rows) is spread
over several parts. A query goes to each part once, with the leaves that it visits there, and keeps its k best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.llm.words import mix
from inkwarp.session import settle, table

NAME = "op8_neighbours"
SQL = None
K, TARGET, PROBES, SAMPLE, LEAF, BRANCHES, ROUNDS, SEED = 10, 0.95, 256, 50_000, 256, 8, 8, 7
#: Rows compared at a time, and rows of the leaves that one task searches for their visitors.
TILE, PART = 1024, 2048
#: Queries of the registered query: ids divisible by this.
EVERY = 20


@dataclass
class Tree:
    """Nodes in breadth-first order; node i's children are first[i] to first[i] + count[i] - 1, and a leaf has none."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: np.ndarray  # rows of the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row by greedy descent."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.count[node])
            if not len(inner):
                return node
            for i in np.unique(node[inner]):
                rows = inner[node[inner] == i]
                c = self.centres[self.first[i] : self.first[i] + self.count[i]]
                node[rows] = self.first[i] + _distances(x[rows], c).argmin(axis=1)

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first leaves that each row's search visits, best bin first; -1 after the last one."""
        distance = _distances(x, self.centres)
        out = np.full((len(x), most), -1, np.int64)
        first, count = self.first.tolist(), self.count.tolist()
        for q in range(len(x)):
            own, queue, n = distance[q].tolist(), [(0.0, 0)], 0
            while queue and n < most:
                _, i = heapq.heappop(queue)
                if not count[i]:
                    out[q, n] = i
                    n += 1
                    continue
                for j in range(first[i], first[i] + count[i]):
                    heapq.heappush(queue, (own[j], j))
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1), 0)


def grow(x: np.ndarray, leaf: int, branches: int = BRANCHES, seed: int = SEED) -> Tree:
    """A tree over sampled rows in which a leaf has at most about leaf of them."""
    rng = np.random.default_rng(seed)
    centres, first, count = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [0], [0]
    waiting = [(0, np.arange(len(x)))]
    for node, rows in waiting:
        if len(rows) <= leaf:
            continue
        own = x[rows]
        k = min(branches, max(2, -(-len(rows) // leaf)))
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(ROUNDS):
            near = _distances(own, c).argmin(axis=1)
            c = np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        near = _distances(own, c).argmin(axis=1)
        parts = [j for j in range(k) if (near == j).any()]
        if len(parts) < 2:  # equal rows
            continue
        first[node], count[node] = len(centres), len(parts)
        for j in parts:
            waiting.append((len(centres), rows[near == j]))
            centres.append(c[j])
            first.append(0)
            count.append(0)
    return Tree(np.stack(centres).astype(np.float64), np.array(first), np.array(count), np.array([len(r) for _, r in waiting]))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k ids nearest to each query but its own, with others at the k-th distance. ids are in order.

    Candidates are found by products, whose rounding the margin covers; their distances are then those of differences.
    """
    d = _distances(q, x)
    d[own[:, None] == ids[None, :]] = np.inf
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    near = d if len(first) == len(ids) else np.minimum.reduceat(d, first, axis=1)  # an id counts once, however often it is there
    if len(first) > k:
        kth = np.partition(near, k - 1, axis=1)[:, k - 1]
        error = 1e-14 * x.shape[1] ** 0.5 * ((q**2).sum(axis=1) + (x**2).sum(axis=1).max())
        r, c = np.nonzero((d <= (kth + 4e-6 * np.sqrt(kth) + 1e-11 + 2 * error)[:, None]) & np.isfinite(d))
    else:
        r, c = np.nonzero(np.isfinite(d))
    exact = np.empty(len(r))
    for low in range(0, len(r), 1 << 16):
        some = slice(low, low + (1 << 16))
        exact[some] = np.sqrt(((q[r[some]] - x[c[some]]) ** 2).sum(axis=1))
    return r, ids[c], np.round(exact, 6)


def _first(r: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, distance) the k nearest different ids of each query; equal distances go by id."""
    order = np.lexsort((d, i, r))
    r, i, d = r[order], i[order], d[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    r, i, d = r[new], i[new], d[new]
    order = np.lexsort((i, d, r))
    r, i, d = r[order], i[order], d[order]
    ok = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[ok], i[ok], d[ok]


def clean(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) that can be searched: with id, not null, of the commonest length, all numbers finite and up to 1e150. Floats stay floats."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    own = own.filter("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) or abs(v) > 1e150)")
    size = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.filter(F.size("embedding") == size["d"]) if size else own.limit(0)


def _sampled(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About most rows, those of least hash; all of fewer."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 32)) < int(most / n * (1 << 32)))


def _groups(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first part, parts) of each leaf: leaves next to each other in the tree, of about PART rows together, are searched by one task; a leaf with more has parts of its own."""
    first, parts, stack, n, at = np.zeros(len(tree.first), np.int64), np.ones(len(tree.first), np.int64), [0], 0, 0
    while stack:
        i = stack.pop()
        if tree.count[i]:
            stack += range(tree.first[i] + tree.count[i] - 1, tree.first[i] - 1, -1)
            continue
        if n and n + rows[i] > PART:
            n, at = 0, at + 1
        first[i], parts[i] = at, max(1, -(-int(rows[i]) // PART))
        n += int(rows[i])
        if parts[i] > 1:
            n, at = 0, at + int(parts[i])
    return first, parts


def _brute(rows: DataFrame, probes: np.ndarray, ids: np.ndarray, tree: Tree, k: int, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, leaves) of each probe's true neighbours."""
    d = probes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column(1), d) - middle, batch.column(0).to_numpy()
            leaf = dict(zip(own.tolist(), tree.leaves(x).tolist(), strict=True))
            order = np.argsort(own, kind="stable")
            p, i, s = _first(*_nearest(probes, x[order], own[order], ids, k), k)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(i), pa.array(s), pa.array([leaf[v] for v in i.tolist()], pa.int64())], ["probe", "vec_id", "distance", "leaf"])

    near = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "vec_id"))
    found = rows.mapInArrow(run, "probe bigint, vec_id bigint, distance double, leaf bigint").withColumn("r", near).filter(F.col("r") <= k).toArrow()
    return found.column("probe").to_numpy(), found.column("leaf").to_numpy()


def calibrated(tree: Tree, probes: np.ndarray, probe: np.ndarray, leaf: np.ndarray, target: float) -> int:
    """The least number of visits that has the target's share of the probes' true neighbours (probe, leaf) in visited leaves."""
    n = int((tree.count == 0).sum())
    visits, most = 1, 16
    while True:
        seen = tree.visits(probes, min(most, n))
        at = (seen[probe] == leaf[:, None]).argmax(axis=1)
        at = np.where((seen[probe] == leaf[:, None]).any(axis=1), at, n)
        shares = np.cumsum(np.bincount(at, minlength=n + 1))[:n] / max(len(at), 1)
        good = np.flatnonzero(shares[: seen.shape[1]] >= target)
        if len(good) or most >= n:
            visits = int(good[0]) + 1 if len(good) else n
            return visits
        most *= 2


def _leaf_sizes(rows: DataFrame, tree: Tree, d: int, middle: np.ndarray) -> np.ndarray:
    """How many rows of the whole table each leaf has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tree.first), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, TILE):
                n += np.bincount(tree.leaves(_matrix(batch.column(0).slice(low, TILE), d) - middle), minlength=len(n))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["leaf", "n"])

    found = rows.select("embedding").mapInArrow(run, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(tree.first), np.int64)
    n[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    return n


def join(rows: DataFrame, k: int = K, target: float = TARGET, leaf: int = LEAF, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour, distance): for every row whose id is divisible by every, its k nearest other rows of the whole table by Euclidean distance, rounded to six decimals.

    Rows without id or embedding, with nulls, NaN, infinite numbers or such beyond 1e150 in it, or of another length than most are
    left out. Of equal distances the least id is first. Rows that repeat an id are searched and found each for itself, never by
    one another, and a neighbour comes once, at its least distance. Fewer than k other rows give fewer. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = settle(clean(rows))
    spark, n = rows.sparkSession, rows.count()
    schema = "vec_id bigint, rank int, neighbour bigint, distance double"
    asks = F.pmod("vec_id", F.lit(every)) == 0
    queries = rows.filter(asks).count()
    if not queries:
        return spark.createDataFrame([], schema)
    d, kind = len(rows.first()["embedding"]), np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64
    sample = _sampled(rows, n, SAMPLE, 1).toArrow().sort_by("vec_id").combine_chunks()
    x = _matrix(sample.column("embedding").combine_chunks(), d) if sample.num_rows else np.zeros((1, d))
    middle = x.mean(axis=0)  # distances are taken from here, as far numbers would lose digits
    tree = grow(x - middle, max(1, round(leaf * len(x) / n)))
    probes = _sampled(rows.filter(asks), queries, PROBES, 2).toArrow().sort_by("vec_id").combine_chunks()
    if not probes.num_rows:
        probes = rows.filter(asks).limit(PROBES).toArrow().combine_chunks()
    px, pid = _matrix(probes.column("embedding").combine_chunks(), d) - middle, probes.column("vec_id").to_numpy()
    visits = calibrated(tree, px, *_brute(rows, px, pid, tree, k, middle), target)
    group, parts = _groups(tree, _leaf_sizes(rows, tree, d, middle))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TILE):
                b = batch.slice(low, TILE)
                y, ids = _matrix(b.column(1), d), b.column(0).to_numpy()
                packed = pa.array([r.tobytes() for r in y.astype(kind)], pa.binary())
                own = tree.leaves(y - middle)
                at = group[own] + mix(ids.view(np.uint64)) % parts[own].astype(np.uint64)
                asking = np.flatnonzero(ids % every == 0)
                seen = tree.visits(y[asking] - middle, visits) if len(asking) else np.zeros((0, 1), np.int64)
                q, v = np.nonzero(seen >= 0)
                leaf = seen[q, v]
                of = np.repeat(np.arange(len(leaf)), parts[leaf])
                to = group[leaf][of] + np.arange(len(of)) - np.searchsorted(of, of)
                q, leaf = q[of], leaf[of].astype(np.int32)
                order = np.lexsort((leaf, to, q))
                q, leaf, to = q[order], leaf[order], to[order]
                new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (to[1:] != to[:-1])])) if len(q) else np.zeros(0, np.int64)
                lists = [z.tobytes() for z in [*own.astype(np.int32), *(np.split(leaf, new[1:]) if len(q) else [])]]
                index = pa.array(np.concatenate([np.arange(len(y)), asking[q[new]]]))
                which = np.concatenate([np.zeros(len(y), np.int8), np.ones(len(new), np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at.astype(np.int64), to[new]])), pa.array(which), b.column(0).take(index), pa.array(lists, pa.binary()), packed.take(index)], ["part", "kind", "vec_id", "leaves", "x"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come part by part, first those that lie there, then the visitors."""
        now, held, by = None, [], {}
        for batch in batches:
            for low in range(0, batch.num_rows, TILE):
                tile = batch.slice(low, TILE)
                at, kinds, who = (tile.column(i).to_numpy() for i in range(3))
                leaves = tile.column(3).to_pylist()
                y = np.frombuffer(b"".join(tile.column(4).to_pylist()), kind).reshape(-1, d).astype(np.float64) - middle
                cuts = np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for low, high in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    if at[low] != now:
                        now, held, by = at[low], [], {}
                    here = np.frombuffer(b"".join(leaves[low:high]), np.int32)
                    if not kinds[low]:
                        held.append((here, who[low:high], y[low:high]))
                        continue
                    if held:
                        leaf, ids, own = (np.concatenate(v) for v in zip(*held, strict=True))
                        order = np.argsort(ids, kind="stable")
                        leaf, ids, own = leaf[order], ids[order], own[order]
                        by, held = {j: (ids[leaf == j], own[leaf == j]) for j in np.unique(leaf).tolist()}, []
                    row = np.repeat(np.arange(low, high), [len(v) // 4 for v in leaves[low:high]])
                    found = []
                    order = np.argsort(here, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(here[order])) + 1):
                        if int(here[some[0]]) in by:
                            ids, own = by[int(here[some[0]])]
                            r = row[some]
                            for t in range(0, len(ids), TILE):
                                p, i, s = _nearest(y[r], own[t : t + TILE], ids[t : t + TILE], who[r], k)
                                found.append((r[p], i, s))
                    if found:
                        r, i, s = _first(*(np.concatenate(v) for v in zip(*found, strict=True)), k)
                        yield pa.RecordBatch.from_arrays([pa.array(who[r]), pa.array(i), pa.array(s)], ["vec_id", "neighbour", "distance"])

    met = rows.mapInArrow(places, "part bigint, kind tinyint, vec_id bigint, leaves binary, x binary").repartition("part").sortWithinPartitions("part", "kind").mapInArrow(meet, "vec_id bigint, neighbour bigint, distance double")
    least = met.groupBy("vec_id", "neighbour").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour"))
    return least.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by EVERY, among all."""
    return join(table(spark, sf_dir, "embeddings"), every=EVERY)
