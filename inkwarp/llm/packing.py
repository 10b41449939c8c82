"""Best-fit packing by length patterns that non-negative least squares fits to the histogram.

Patterns of one to DEPTH length classes that fill a pack exactly are enumerated; non-negative least squares
finds how often each should be used to use up the histogram of classes, short classes weighing less as
they are easy to place elsewhere. Repeat counts are rounded and cut to what is there; what is left goes,
longest first, to the fullest open pack that has room (best fit), else to a new one. All this works on
counts by exact length, so the plan has one size whatever the number of documents: a list of runs
"the k-th to m-th pieces of this length go to these packs at this offset". Pieces get their rank among
those of their length from a count by (length, bucket) and a rank within it, and find their run by a join. A length has
a bucket for each BUCKET pieces, so no task ranks more at a time, however many pieces are of one length (whole contexts mostly are).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.session import settle, table

NAME = "op1_packing"
CONTEXT, CLASSES, DEPTH, BUCKET = 2048, 64, 4, 1 << 18
SQL = None


def token_count(text) -> F.Column:
    """Tokens of a text: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("bigint")


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most depth classes that add up to the number of classes."""
    found = [(classes,)]
    for k in range(1, depth):
        for some in combinations_with_replacement(range(1, classes), k):
            last = classes - sum(some)
            if last >= some[-1]:
                found.append((*some, last))
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """min |a x - b|, x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    limit = 1e-10 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * n):
        slope = right - gram @ x
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if active.all() or slope[j] <= limit:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            active[at[bad & (x[at] <= 1e-12)]] = False
            if active[j] and x[j] <= 1e-12:
                active[j] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], context: int = CONTEXT, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first pack, offset) that place every piece of a histogram {length: count}.

    Rank k of a run's length goes to pack first pack + k - first rank. Lengths are 1 to context.
    """
    step = -(-context // classes)
    classes, whole = -(-context // step), context // step  # whole: classes that surely fit
    count = np.zeros(classes + 1)
    for length, c in histogram.items():
        count[-(-length // step)] += c
    left, next_rank = dict(histogram), defaultdict(int)
    lengths_of: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left):  # a class gives its longest first
        lengths_of[-(-length // step)].append(length)
    runs, packs = [], 0
    open_packs: dict[int, list[list[int]]] = defaultdict(list)  # room: [first pack, packs]

    def take(c: int, most: int) -> tuple[int, int]:
        """(length, pieces): up to most of one length of a class."""
        while not left[lengths_of[c][-1]]:
            lengths_of[c].pop()
        length = lengths_of[c][-1]
        return length, min(most, left[length])

    def place(length: int, k: int, pack: int, offset: int) -> None:
        runs.append((length, next_rank[length], k, pack, offset))
        next_rank[length] += k
        left[length] -= k

    every = patterns(whole, depth) + ([(classes,)] if classes > whole else [])
    used = [p for p in every if all(count[c] for c in p)]
    if used:
        a = np.zeros((classes, len(used)))
        for j, p in enumerate(used):
            for c in p:
                a[c - 1, j] += 1
        weight = np.sqrt(np.arange(1, classes + 1) / classes)
        times = nnls(a * weight[:, None], count[1:] * weight)
        there = count.copy()
        for j in sorted(np.flatnonzero(times > 0.5), key=lambda j: (-times[j], used[j])):
            of = np.bincount(used[j], minlength=classes + 1)
            repeats = int(min(round(times[j]), *(there[c] // of[c] for c in np.flatnonzero(of))))
            if repeats < 1:
                continue
            there -= of * repeats
            # rooms of the pattern's packs, as stretches of packs of equal filling
            stretches = [(packs, repeats, 0)]
            packs += repeats
            for c in reversed(used[j]):
                after = []
                for pack, k, filled in stretches:
                    while k:
                        length, some = take(c, k)
                        place(length, some, pack, filled)
                        after.append((pack, some, filled + length))
                        pack, k = pack + some, k - some
                stretches = after
            for pack, k, filled in stretches:
                open_packs[context - filled].append([pack, k])
    rooms = sorted(open_packs)
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            i = int(np.searchsorted(rooms, length))
            if i == len(rooms):
                per = context // length  # a new pack holds as many of this length as fit
                k = max(1, left[length] // per)
                pack, packs, filled = packs, packs + k, 0
                for _ in range(min(per, left[length])):
                    some = min(k, left[length])
                    place(length, some, pack, filled)
                    filled += length
                room, pack_list = context - filled, [pack, k]
            else:
                room = rooms[i]
                pack, k = open_packs[room].pop()
                if not open_packs[room]:
                    rooms.pop(i)
                some = min(k, left[length])
                place(length, some, pack, context - room)
                if some < k:
                    open_packs[room].append([pack + some, k - some])
                    if i == len(rooms) or rooms[i] != room:
                        rooms.insert(i, room)
                room, pack_list = room - length, [pack, some]
            if room:
                if not open_packs[room]:
                    rooms.insert(int(np.searchsorted(rooms, room)), room)
                open_packs[room].append(pack_list)
    return runs


def pieces(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): documents cut into pieces of at most context tokens."""
    n = docs.select(F.col("doc_id").cast("bigint"), token_count(F.col("text")).alias("n")).filter("n > 0")
    cut = n.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(context).cast("bigint"))).alias("piece", "first_token"))
    return cut.select("doc_id", "piece", "first_token", F.least(F.lit(context), F.col("n") - F.col("first_token")).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, context: int = CONTEXT, classes: int = CLASSES, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, first_token, n_tokens, pack_id, pack_offset).

    A document of more than context tokens is cut into pieces of context tokens and a last one. Tokens
    are runs of characters other than white space. A document without tokens (null, empty or blank text)
    takes no room and has no row. Rows that repeat an id, and those without id, are packed one by one. Equal
    lengths go by a hash of id and piece, then these; rows alike in all that are interchangeable. Other columns
    are ignored. An empty table gives no rows.
    """
    found = settle(pieces(docs, context))
    of_length = dict(found.groupBy("n_tokens").count().collect())  # at most context rows
    spark = docs.sparkSession
    split = {n: -(-k // bucket) for n, k in of_length.items() if k > bucket}
    parts = F.coalesce(F.create_map(*(F.lit(x) for n, k in split.items() for x in (n, k)))[F.col("n_tokens")], F.lit(1)) if split else F.lit(1)
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    firsts = [(n, 0, 0) for n in of_length if n not in split]
    if split:  # about a row for each bucket pieces
        at: dict[int, int] = defaultdict(int)
        for n, b, k in found.filter(F.col("n_tokens").isin(list(split))).groupBy("n_tokens", "bucket").count().orderBy("n_tokens", "bucket").collect():
            firsts.append((n, b, at[n]))
            at[n] += k
    runs = plan(of_length, context, classes, depth)
    first = spark.createDataFrame(firsts, "n_tokens int, bucket int, first bigint")
    run = spark.createDataFrame(runs, "n_tokens int, low bigint, k bigint, pack bigint, pack_offset int")
    own = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = found.withColumn("r", F.row_number().over(own)).join(F.broadcast(first), ["n_tokens", "bucket"]).withColumn("rank", F.col("first") + F.col("r") - 1)
    # runs by length, in one array each: a piece looks through those of its own length
    of_length = run.groupBy("n_tokens").agg(F.sort_array(F.collect_list(F.struct("low", "k", "pack", "pack_offset"))).alias("runs"))
    placed = ranked.join(F.broadcast(of_length), "n_tokens").withColumn("run", F.filter("runs", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["low"] + x["k"]))[0])
    return placed.select("doc_id", "piece", "first_token", "n_tokens", (F.col("run.pack") + F.col("rank") - F.col("run.low")).alias("pack_id"), F.col("run.pack_offset").alias("pack_offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
