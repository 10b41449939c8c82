"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of tokens. Documents are counted by source and exact token length. A source takes the same
share of every length, rounded down, and one more of the lengths with the largest remainders, up to the last WINDOW tokens of its budget; how many more of which lengths fill what is left
is found by a bounded knapsack over lengths, with sets of reachable sums as bits. If that doesn't meet the budget, the window
is eight times as large, up to the whole budget or WORK, so a budget within WORK is met as nearly as its documents allow. Beyond it
the longest that fit are taken in bulk, down to what the knapsack can do. Of each length, documents of least keyed hash are selected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.llm.packing import token_count
from inkwarp.session import settle, table

NAME = "op10_mixing"
SQL = None
#: Default weights: tokens of the source to this power. SEED: of the selection.
POWER, SEED, WINDOW = 0.7, 20240601, 1 << 16
#: A knapsack's bits are its window's tokens by its lengths' pieces; with more than this (1.3 GB moved) it isn't tried.
WORK = 1 << 33
#: Cuts of up to so many (source, length) go to the executors as a broadcast, more by a join that shuffles.
BROADCAST_ROWS = 1_000_000


def _pieces(lengths: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """(index, pieces): counts that fit the budget, split into powers of two, long lengths first."""
    parts = []
    for i in np.argsort(-lengths, kind="stable"):
        if not counts[i]:
            continue
        left, k = min(int(counts[i]), budget // int(lengths[i])), 1
        while left:
            parts.append((int(i), min(k, left)))
            left, k = left - min(k, left), 2 * k
    return parts


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, counts at most, to come as near as possible to the budget from below.

    Sums are sets of bits. Only the piece that first reached a sum is kept for each, in one array, so memory doesn't grow with the lengths.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    scale = int(np.gcd.reduce(lengths[counts > 0])) if (counts > 0).any() else 1
    lengths, budget = lengths // scale, budget // scale
    parts = _pieces(lengths, counts, budget)
    full, reach = (1 << (budget + 1)) - 1, 1
    via = np.zeros(budget + 1, np.int32)
    for j, (i, k) in enumerate(parts, 1):
        new = (reach << (k * int(lengths[i]))) & full & ~reach
        if new:
            some = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little"))
            via[some] = j
            reach |= new
        if reach >> budget:
            break
    at = reach.bit_length() - 1
    while at:  # a sum's piece is later than those of what it was added to
        i, k = parts[via[at] - 1]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, work: int = WORK) -> np.ndarray:
    """How many documents of each length a source gives for its budget."""
    have = int((lengths * counts).sum())
    if budget >= have:
        return counts.astype(np.int64)
    best, least = None, budget + 1
    while True:
        exact = counts * (max(0, budget - window) / have)
        take = np.floor(exact + 1e-9).astype(np.int64)
        left = budget - int((lengths * take).sum())
        for i in np.lexsort((lengths, take - exact)):  # largest remainders first
            if left <= 2 * window:
                break
            if take[i] < counts[i] and lengths[i] <= left - window:
                take[i] += 1
                left -= int(lengths[i])
        for i in np.argsort(-lengths, kind="stable") if left > 2 * window else ():  # still much left: long lengths, in bulk
            more = min(int(counts[i] - take[i]), (left - window) // int(lengths[i]))
            if more > 0:
                take[i] += more
                left -= more * int(lengths[i])
        rest = counts - take
        scale = int(np.gcd.reduce(lengths[rest > 0])) if (rest > 0).any() else 1
        if best is None or len(_pieces(lengths, rest, left)) * (left // scale) <= work:
            while best is None and len(_pieces(lengths, rest, left)) * (left // scale) > work:  # take more, so that the first knapsack can be done
                i = max(np.flatnonzero((rest > 0) & (lengths <= left)), key=lambda i: lengths[i])
                more = max(1, min(int(rest[i]), left // 2 // int(lengths[i])))
                take[i], rest[i], left = take[i] + more, rest[i] - more, left - more * int(lengths[i])
            take = take + knapsack(lengths, rest, left)
            gap = budget - int((lengths * take).sum())
            if gap < least:
                best, least = take, gap
        else:
            break
        if not least or window >= budget:
            break
        window *= 8
    return best


def budgets(tokens: dict[str, int], weights: dict[str, float] | None = None, total: int | None = None) -> dict[str, int]:
    """Tokens for each source: in the ratio of the weights, but a source that has fewer gives all it has and the others share what it leaves.

    With a total these are so many, or all there are. Without one, the tokens of a unit of weight are: without weights (tokens
    to the power POWER) those of all sources together; with weights those of the scarcest sources that have half of the weight
    or more, so that a ratio of a few sources is exact while sources of little weight can't shrink the mix. Sources without a
    weight, or with weight 0, get nothing.
    """
    given = weights is not None
    weights = {s: w for s, w in weights.items() if w > 0 and tokens.get(s)} if given else {s: float(n) ** POWER for s, n in tokens.items() if n}
    if not weights:
        return {}
    order = sorted(weights, key=lambda s: (tokens[s] / weights[s], s))
    whole, most = sum(weights.values()), sum(tokens[s] for s in weights)
    if total is not None:
        left, rest, unit = min(total, most), whole, 0.0
        for s in order:
            unit = left / rest
            if tokens[s] >= unit * weights[s]:
                break
            left, rest = left - tokens[s], rest - weights[s]
    elif given:
        upto = 0.0
        for s in order:
            unit, upto = tokens[s] / weights[s], upto + weights[s]
            if upto >= whole * (0.5 - 1e-9):
                break
    else:
        unit = most / whole
    return {s: min(tokens[s], int(unit * w + 1e-6)) for s, w in weights.items()}


def _marked(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns of docs), mix_source, mix_tokens, mix_hash."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("mix_source"), token_count(docs["text"]).alias("mix_tokens"), F.xxhash64(docs["doc_id"].cast("bigint"), F.lit(seed)).alias("mix_hash"))


def _cuts(docs: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int) -> DataFrame:
    """(mix_source, mix_tokens, cut, at_cut, some): hashes below cut are selected, and at_cut rows of hash cut; some: not all of these."""
    keys = ["mix_source", "mix_tokens"]
    marks = settle(_marked(docs.select("doc_id", "text", "source"), seed).select(*keys, "mix_hash").filter("mix_tokens > 0").groupBy(*keys, "mix_hash").agg(F.count("*").alias("n")))
    counts = marks.groupBy(*keys).agg(F.sum("n").alias("n"))
    tokens = {r[0]: r[1] for r in counts.groupBy("mix_source").agg(F.sum(F.col("mix_tokens") * F.col("n"))).collect()}
    budget = budgets(tokens, weights, total)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("mix_tokens")
        take = fit(t["mix_tokens"].to_numpy(), t["n"].to_numpy(), budget.get(t["mix_source"].iloc[0], 0))
        return t.assign(take=take)[["mix_source", "mix_tokens", "take"]][take > 0]

    takes = counts.groupBy("mix_source").applyInPandas(run, "mix_source string, mix_tokens bigint, take bigint")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("mix_hash"))
    ranked = marks.join(takes, keys).withColumn("upto", upto)
    return ranked.filter("upto >= take and upto - n < take").select(*keys, F.col("mix_hash").alias("cut"), (F.col("take") - F.col("upto") + F.col("n")).alias("at_cut"), (F.col("upto") > F.col("take")).alias("some"))


def selected(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(row, mix_source, mix_tokens): the selected rows, as structs of all their columns.

    No source is above its budget, and each is as near to it as fit() gets: as near as can be where a knapsack over its whole
    budget is within WORK, else to what the last window leaves. A null source is the source "". Rows
    without tokens are not selected. Rows that repeat an id have one hash; where a cut falls among rows of one hash, as many
    of them as needed are selected, those of least text. Other columns pass, whatever their names. An empty table gives no rows.
    """
    cuts = settle(_cuts(docs, weights, total, seed))
    n = cuts.count()
    cuts_ = F.broadcast(cuts) if n <= BROADCAST_ROWS else cuts
    found = _marked(docs, seed).join(cuts_, ["mix_source", "mix_tokens"]).filter("mix_hash <= cut")
    if not cuts.filter("some").isEmpty():
        order = Window.partitionBy("mix_source", "mix_tokens", "mix_hash").orderBy("row.text")
        part = found.filter("some and mix_hash = cut").withColumn("mix_row", F.row_number().over(order)).filter("mix_row <= at_cut").drop("mix_row")
        found = found.filter("not some or mix_hash < cut").unionByName(part)
    return found.select("row", "mix_source", "mix_tokens")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows of docs, with its columns."""
    return selected(docs, weights, total, seed).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the selected documents."""
    found = selected(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("row.doc_id", F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"))
