"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word n-grams. All sets are put in one global order, rare grams first. Of a set of
n grams and a threshold t, the l-prefix is its first n - ceil(t n) + l grams; two sets of Jaccard
similarity t or more share at least l grams of their l-prefixes, for every l up to the overlap that
they need. A longer prefix gives more postings to scan but demands more matches, so fewer pairs are left to
verify. Each document gets the l whose estimated cost is least.

* Documents with equal sets are one record, named by a 64-bit fingerprint of the set.
* Grams meet in one exchange, split by hash range; there a gram is its range and its place in it (together all 64 bits of
  its hash), and its document a number within a slice of rows. Each range first says only which rows of which slice have grams that
  others have too. A gram that one record alone has takes a place at the front of its prefix and can match
  nothing, so documents with enough of them leave. Of those that stay, one for each record, the ranges where they have
  such grams are then asked for them, with frequencies among those that stay.
* Grams in very many documents (license lines) are counted with the fingerprints; they need no range, as they are repeated
  for sure: a slice keeps its own, so no task holds all documents of one gram.
* Postings meet by gram. Grams of a family of near copies have much the same posting lists, so lists
  are gathered by their least record and matches added up there, with matrix products where lists are
  long; lists of more than BLOCK records are split into blocks that meet pairwise.
* A candidate's intersection is counted from the two records' repeated grams (others can't be shared),
  brought together by the gram of least hash of each, which near copies mostly have in common; families of
  more than BLOCK records are split into blocks that meet pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.llm.words import column_words, grams, mix, slices, trim
from inkwarp.operators.networks import components
from inkwarp.session import settle, table

NAME = "op6_jaccard_join"
N, THRESHOLD, MOST_MATCHES, BLOCK, SHORT = 3, 0.5, 4, 2048, 24
#: Bytes of text for one hash range; its grams take about ten times as much in a worker.
RANGE_BYTES = 10_000_000
#: Bytes of text that share one numbering of rows.
SLICE = 4_000_000
#: Rows of a slice at most, as they are numbered in 16 bits.
MOST_ROWS = 1 << 16
#: Up to so many ids of rows to drop go to the executors as a broadcast (8 MB), more by a join that shuffles.
BROADCAST_IDS = 1_000_000
#: A gram is a candidate of the heavy ones in a slice where so many documents have it. Heavy are those with HEAVY documents in
#: such slices, the MOST_HEAVY in most at most (8 MB in a task); others go by range.
HEAVY_IN_SLICE, HEAVY, MOST_HEAVY = 8, 1 << 17, 1_000_000
#: What a worker holds at once when it adds up matches: postings (about 60 bytes each), pairs (about 60), cells of a matrix (4).
PIECE, PAIRS, CELLS = 1 << 19, 500_000, 1 << 22
#: Grams of a set that cross to a worker in one row, and those of the sets that meet in one block.
CHUNK, BLOCK_GRAMS = 256, 1 << 20


def _records(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, offsets, fingerprints, sizes) of a text column."""
    hashes, rows = column_words(column)
    g, at = grams(hashes, rows, len(column), n)
    sizes = np.diff(at)
    prints = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        prints[some] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at[some])
    return g, at, mix(prints ^ mix(sizes.astype(np.uint64))).view(np.int64), sizes


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, record, size) of every document that has an id and a word; where doc_id is null, a gram and minus its documents in a slice, if these are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE, MOST_ROWS):
            g, _, prints, sizes = _records(batch.column(1), n)
            g.sort()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(g)))
            many = count >= HEAVY_IN_SLICE
            some = np.flatnonzero(sizes)
            ids = pa.concat_arrays([batch.column(0).cast(pa.int64()).take(pa.array(some)), pa.nulls(int(many.sum()), pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([prints[some], g[new[many]].view(np.int64)])), pa.array(np.concatenate([sizes[some], -count[many]]).astype(np.int32))], ["doc_id", "record", "size"])
            del g
            trim()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id bigint, record bigint, size int")


def _marks(docs: DataFrame, n: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The documents of signatures, and the heavy grams in ascending order with their frequency classes."""
    every = settle(signatures(docs, n))
    heavy = every.filter("doc_id is null").groupBy("record").agg(F.sum(-F.col("size").cast("bigint")).alias("df")).filter(F.col("df") >= HEAVY)
    t = heavy.orderBy(F.desc("df"), "record").limit(MOST_HEAVY).toArrow()
    gram, df = t.column("record").to_numpy().view(np.uint64), t.column("df").to_numpy()
    order = np.argsort(gram)
    # slices with few of a gram don't report it, so its class is one more
    return every.filter("doc_id is not null"), (gram[order], (np.log2(np.maximum(df[order], 1)) * 4 + 1).astype(np.int64))


_ASKED = "part int, slice bigint, row binary, low binary, high binary"


def _bounds(part: np.ndarray, ranges: int) -> np.ndarray:
    """The least upper half of a hash in each range."""
    return ((part.astype(np.uint64) << np.uint64(32)) + np.uint64(ranges - 1)) // np.uint64(ranges)


def _width(ranges: int) -> int:
    """Bytes for the place of a hash's upper half in its range."""
    return next(w for w in (1, 2, 3, 4) if (1 << 32) // ranges < 1 << (8 * w) or w == 4)


def _blobs(docs: DataFrame, n: int, ranges: int, heavy: np.ndarray) -> DataFrame:
    """Grams by hash range and slice of rows. Negative parts hold each slice's records and sizes (odd), and its heavy grams (even)."""
    width = _width(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, 0, SLICE, MOST_ROWS)):
            g, at, prints, sizes = _records(batch.column(0), n)
            name = task << 32 | number
            row = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            out: list[tuple] = [(-1 - 2 * (name % ranges), name, b"", prints.tobytes(), sizes.astype(np.int32).tobytes())]
            if len(heavy) and len(g):
                which = np.minimum(np.searchsorted(heavy, g), len(heavy) - 1)
                hit = heavy[which] == g
                if hit.any():
                    out.append((-2 - 2 * (name % ranges), name, row[hit].tobytes(), which[hit].astype(np.int32).tobytes(), b""))
                    g, row = g[~hit], row[~hit]
            high = g >> np.uint64(32)
            part = ((high * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            g, high, row, part = g[order], high[order], row[order], part[order]
            there, begin = np.unique(part, return_index=True)
            low, place = g.astype(np.uint32), (high - _bounds(part, ranges)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
            out += [(p, name, row[x:y].tobytes(), low[x:y].tobytes(), place[x:y].tobytes()) for p, x, y in zip(there.tolist(), begin, np.append(begin, len(g))[1:], strict=True)]
            del g, high, row, part, order, low, place
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "slice", "row", "low", "high"])
            del out, prints, sizes, at
            trim()

    rows = docs.select(F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, _ASKED)


def _bytes(t: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]


def _tokens(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, row, number of its blob) of one range."""
    rows = _bytes(t, "row", np.uint16)
    ends = np.cumsum([0, *map(len, rows)])
    tokens = np.zeros(ends[-1], "<u8")
    low, high = tokens.view("<u4").reshape(-1, 2)[:, 0], tokens.view(np.uint8).reshape(-1, 8)[:, 4 : 4 + width]
    for x, y, own, place in zip(ends[:-1], ends[1:], _bytes(t, "low", np.uint32), _bytes(t, "high", np.uint8), strict=True):  # filled in place, as copies are large
        low[x:y], high[x:y] = own, place.reshape(-1, width)
    return tokens, np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(ends))


_COUNTED = "slice bigint, part int, low binary, high binary"


def _count(width: int):
    def run(t: pa.Table) -> pa.Table:
        """For one range: the rows of grams that occur again, one for each. Of negative parts, those with heads pass and those of heavy grams give their rows."""
        part = t.column("part")[0].as_py()
        if part < 0:
            return t.select(["slice", "part", "low", "high"]) if part % 2 else pa.table({"slice": t.column("slice"), "part": t.column("part"), "low": t.column("row"), "high": pa.array([None] * t.num_rows, pa.binary())})
        tokens, row, blob = _tokens(t, width)
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        ends = np.searchsorted(blob[again], np.arange(t.num_rows + 1))
        found = row[again]
        del tokens, order, same, row
        trim()
        some = pa.array(ends[1:] > ends[:-1])
        return pa.table({"slice": t.column("slice"), "part": t.column("part"), "low": pa.array([found[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "high": pa.array([None] * t.num_rows, pa.binary())}).filter(some)

    return run


def _sieve(t: float):
    def run(table: pa.Table) -> pa.Table:
        """For one slice: the documents of which not too many grams are theirs alone."""
        is_head = np.array([x.is_valid for x in table.column("high")])
        i = int(np.flatnonzero(is_head)[0])
        prints, sizes = (np.frombuffer(table.column(c)[i].as_buffer(), k) for c, k in (("low", np.int64), ("high", np.int32)))
        again = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x.as_buffer(), np.uint16) for x, head in zip(table.column("low"), is_head, strict=True) if not head)])
        there = np.bincount(again, minlength=len(sizes))
        stay = np.flatnonzero((sizes > 0) & (there >= np.ceil(sizes * t - 1e-9)))
        return pa.table({"slice": np.full(len(stay), table.column("slice")[0].as_py()), "row": stay.astype(np.int32), "record": prints[stay], "size": sizes[stay]})

    return run


def _ask(left: pa.Table, right: pa.Table) -> pa.Table:
    """For one slice: which of its rows to ask each range for, where they have repeated grams."""
    wanted = np.zeros(1 << 16, bool)
    if right.num_rows:
        wanted[right.column("row").to_numpy()] = True
    out: list[tuple] = []
    for name, part, rows, head in zip(*(left.column(c) for c in ("slice", "part", "low", "high")), strict=True):
        if right.num_rows and not head.is_valid:
            own = np.unique(np.frombuffer(rows.as_buffer(), np.uint16))
            own = own[wanted[own]]
            if len(own):
                out.append((part.as_py(), name.as_py(), own.tobytes()))
    parts, names, rows = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"part": pa.array(parts, pa.int32()), "slice": pa.array(names, pa.int64()), "rows": pa.array(rows, pa.binary())})


def _answer(width: int, ranges: int, classes: np.ndarray):
    empty = pa.table({c: pa.array([], k) for c, k in (("slice", pa.int64()), ("part", pa.int32()), ("row", pa.binary()), ("token", pa.binary()))})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """For one range: the repeated grams of the rows asked for, as frequency class (8 bits) and rank by frequency (24 bits)."""
        if not left.num_rows or not right.num_rows:
            return empty
        asked = dict(zip(right.column("slice").to_pylist(), _bytes(right, "rows", np.uint16), strict=True))
        left = left.filter(pc.is_in(left.column("slice"), right.column("slice")))
        keep = []
        for name, row in zip(left.column("slice").to_pylist(), _bytes(left, "row", np.uint16), strict=True):
            wanted = np.zeros(1 << 16, bool)
            wanted[asked[name]] = True
            keep.append(wanted[row])
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        if not keep.any():
            return empty
        if left.column("part")[0].as_py() < 0:
            which, row = np.concatenate(_bytes(left, "low", np.int32)), np.concatenate(rows := _bytes(left, "row", np.uint16))
            blob = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[keep]
            row, code = row[keep], (classes[which] << 24 | which).astype(np.uint32)[keep]
            part = pa.array(np.full(left.num_rows, ranges, np.int32))
        else:
            tokens, row, blob = (x[keep] for x in _tokens(left, width))
            _, back, df = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.empty(len(df), np.int64)
            rank[np.argsort(df, kind="stable")] = np.arange(len(df)) - np.count_nonzero(df == 1)
            keep = df[back] > 1
            row, blob, back = row[keep], blob[keep], back[keep]
            code = (np.log2(df) * 4).astype(np.uint32)[back] << np.uint32(24) | rank[back].astype(np.uint32)
            part = left.column("part")
            del tokens, df, rank, back
        ends = np.searchsorted(blob, np.arange(left.num_rows + 1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        out = pa.table({"slice": left.column("slice"), "part": part, "row": cut(row), "token": cut(code)})
        del keep
        trim()
        return out.filter(pa.array(ends[1:] > ends[:-1]))

    return run


_SURVIVOR = "record bigint, size int, alone int, base int, matches int, least bigint, tokens array<bigint>"


def _assemble(t: float, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """For one slice: the records that may have partners, with their repeated grams in the global order and the best l.

        The cost of an l is the postings scanned and the pairs verified, at most scanned / l, each at the cost of merging two sets.
        """
        rows = [*_bytes(left, "row", np.uint16), np.zeros(0, np.uint16)] if left.num_rows else [np.zeros(0, np.uint16)]
        codes = np.concatenate([*(_bytes(left, "token", np.uint32) if left.num_rows else []), np.zeros(0, np.uint32)]).astype(np.int64)
        part = np.repeat([*left.column("part").to_pylist(), 0] if left.num_rows else [0], [len(x) for x in rows]).astype(np.int64)
        row = np.concatenate(rows)
        # class of frequency, range, rank: ascending is the global order
        tokens = (codes >> 24) << 56 | part << 24 | (codes & 0xFFFFFF)
        order = np.lexsort((tokens, row))
        row, tokens = row[order], tokens[order]
        own, size, record = (right.column(c).to_numpy() for c in ("row", "size", "record"))
        first, last = np.searchsorted(row, own), np.searchsorted(row, own, "right")
        need = np.ceil(size * t - 1e-9).astype(np.int64)
        alone, base = size - (last - first), size - need
        scanned = np.concatenate([[0.0], np.cumsum(np.exp2((tokens >> 56) / 4))])
        cost = np.full((most, len(own)), np.inf)
        for k in range(1, most + 1):
            long = np.clip(base + k - alone, 0, last - first)
            s = scanned[first + long] - scanned[first]
            cost[k - 1] = np.where((need >= k) | (k == 1), s + s / k * size / 16, np.inf)
        stay = alone <= base
        lists = [tokens[a:b] for a, b in zip(first[stay], last[stay], strict=True)]
        least = [int(mix(x.view(np.uint64)).min() >> np.uint64(1)) if len(x) else 0 for x in lists]
        flat = np.concatenate([np.zeros(0, np.int64), *lists])
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = (record[stay], size[stay], alone[stay].astype(np.int32), base[stay].astype(np.int32), cost.argmin(axis=0)[stay].astype(np.int32) + 1, np.array(least, np.int64), pa.ListArray.from_arrays(at, pa.array(flat)))
        del rows, codes, part, row, tokens, order, scanned, lists, flat
        trim()
        return pa.table(dict(zip(("record", "size", "alone", "base", "matches", "least", "tokens"), values, strict=True)))

    return run


def _survivors(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], n: int, t: float, most: int) -> DataFrame:
    """(record, size, alone, base, matches, least, tokens): records that may have partners; tokens are the repeated grams in the global order."""
    length = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(1, math.ceil(length / RANGE_BYTES))
    width = _width(ranges)
    blobs = _blobs(docs, n, ranges, heavy[0])
    counted = blobs.groupBy("part").applyInArrow(_count(width), _COUNTED)
    stay = counted.groupBy("slice").applyInArrow(_sieve(t), "slice bigint, row int, record bigint, size int")
    one = stay.groupBy("record").agg(F.min(F.struct("slice", "row", "size")).alias("at")).select("at.*", "record")
    asked = counted.groupBy("slice").cogroup(one.groupBy("slice")).applyInArrow(_ask, "part int, slice bigint, rows binary")
    answered = blobs.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_answer(width, ranges, heavy[1]), "slice bigint, part int, row binary, token binary")
    return answered.groupBy("slice").cogroup(one.groupBy("slice")).applyInArrow(_assemble(t, most), _SURVIVOR)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of posting lists, of which first marks the beginnings, in pieces of whole lists of about most rows; a home is split where it has about half as many or more."""
    held, n = [], 0
    for batch in (b.slice(low, most) for b in batches for low in range(0, b.num_rows, most)):
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            starts, home = np.flatnonzero(t.column("first").to_numpy()), t.column("home").to_numpy()
            starts = starts[1:]
            homes = starts[home[starts] != home[starts - 1]]
            cut = int(homes[-1]) if len(homes) and homes[-1] >= n // 2 else int(starts[-1]) if len(starts) else 0
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), n - cut
            del t, home
    if n:
        yield pa.Table.from_batches(held)


def _matches(t: float, most: int):
    """Adds up the matches of posting lists, which come posting by posting in the order of their homes."""

    def small(e: dict, names: np.ndarray, back: np.ndarray, at: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
        found = []
        for length in np.unique(k):
            i, j = np.triu_indices(length, 1)
            base = at[k == length][:, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            swap = (e["size"][a] < e["size"][b]) | (e["size"][a] == e["size"][b]) & (e["record"][a] < e["record"][b])
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            sa, sb, pa_, pb = e["size"][a], e["size"][b], e["pos"][a], e["pos"][b]
            most_shared = np.minimum(pa_, pb) + np.minimum(sa - pa_, sb - pb)
            ok = (np.maximum(e["level"][a], e["level"][b]) <= e["matches"][a]) & (sb >= sa * t - 1e-9) & (most_shared * (1 + t) >= t * (sa + sb) - 1e-6) & (e["record"][a] != e["record"][b])
            ok &= ~e["cross"][a] | (e["half"][a] != e["half"][b])
            found.append((a[ok], b[ok]))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        key, first, shared = np.unique(back[a] * np.int64(len(names)) + back[b], return_index=True, return_counts=True)
        yield names[key // len(names)], names[key % len(names)], shared, e["matches"][a[first]]

    def large(e: dict, at: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
        """One home's lists."""
        where = np.concatenate([np.arange(x, x + y) for x, y in zip(at, k, strict=True)])
        row = np.repeat(np.arange(len(k)), k)
        names, first, back = np.unique(e["record"][where], return_index=True, return_inverse=True)
        size, matches, half = (e[c][where][first] for c in ("size", "matches", "half"))
        if len(names) > 3 * BLOCK or len(names) * len(k) > CELLS:
            if len(k) > 1:
                del where, row, names, first, back, size, matches, half
                middle = len(k) // 2
                yield from large(e, at[:middle], k[:middle])
                yield from large(e, at[middle:], k[middle:])
                return
        step = max(1, min(256, PAIRS // len(names)))
        for few in range(1, most + 1):
            asks = np.flatnonzero(matches == few)
            if not len(asks):
                continue
            b = np.zeros((len(k), len(names)), np.float32)
            ok = e["level"][where] <= few
            b[row[ok], back[ok]] = 1
            for low in range(0, len(asks), step):
                some = asks[low : low + step]
                shared = b[:, some].T @ b
                x, y = np.nonzero(shared)
                n = shared[x, y].astype(np.int64)
                x = some[x]
                ok = ((size[y] < size[x]) | (size[y] == size[x]) & (names[y] < names[x])) & (size[y] >= size[x] * t - 1e-9)
                if e["cross"][where[0]]:
                    ok &= half[x] != half[y]
                yield names[x[ok]], names[y[ok]], n[ok], matches[x[ok]]

    def added(e: dict, home: np.ndarray, at: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
        short = k <= SHORT
        which, weight = np.flatnonzero(short), k[short] ** 2
        names, back = np.unique(e["record"], return_inverse=True)
        for some in np.split(which, np.searchsorted(np.cumsum(weight), np.arange(2 * PAIRS, weight.sum(), 2 * PAIRS))):
            yield from small(e, names, back, at[some], k[some])
        del names, back
        long = np.flatnonzero(~short)
        for some in np.split(long, np.flatnonzero((home[long][1:] != home[long][:-1]) | (e["cross"][at[long]][1:] | e["cross"][at[long]][:-1])) + 1) if len(long) else ():
            yield from large(e, at[some], k[some])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        a, b, shared, matches = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.minimum(shared, 127).astype(np.int8)), pa.array(matches.astype(np.int8))], ["a", "b", "shared", "matches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, PIECE):
            e = {c: piece.column(c).to_numpy() for c in ("cross", "record", "size", "matches", "level", "pos", "half")}
            at = np.flatnonzero(piece.column("first").to_numpy())
            k, home = np.diff(np.append(at, piece.num_rows)), piece.column("home").to_numpy()[at]
            found, n = [], 0
            for some in added(e, home, at, k):
                found.append(some)
                n += len(some[0])
                if n >= PAIRS:  # yielded as they come, as a family's pairs grow with its square
                    yield batch(found)
                    found, n = [], 0
            if n:
                yield batch(found)
            del e, found, piece
            trim()

    return run


def _candidates(survivors: DataFrame, t: float, most: int) -> DataFrame:
    """(a, b): a is the larger record and probes with its own l; b is found under any l."""
    at = survivors.select("record", "size", "matches", "base", "alone", F.posexplode(F.slice("tokens", 1, F.col("base") + most - F.col("alone"))).alias("p", "token"))
    # a list longer than BLOCK is split; the class of frequency tells its length to a fifth
    blocks = F.ceil(F.pow(F.lit(2.0), (F.shiftright("token", 56) + 1) / 4) / BLOCK).cast("int")
    posted = at.select("token", F.pmod(F.xxhash64("record"), blocks).cast("int").alias("half"), blocks.alias("blocks"), "record", "size", F.col("matches").cast("tinyint"), F.greatest(F.lit(1), F.col("alone") + F.col("p") + 1 - F.col("base")).cast("tinyint").alias("level"), (F.col("alone") + F.col("p")).alias("pos"))
    posted = posted.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("token", F.least("half", "other").alias("x"), F.greatest("half", "other").alias("y"), F.struct("record", "size", "matches", "level", "pos", F.col("half").cast("int").alias("half")).alias("e"))
    lists = posted.groupBy("token", "x", "y").agg(F.collect_list("e").alias("e")).filter(F.size("e") > 1).select(F.array_min(F.transform("e", lambda v: v["record"])).alias("home"), "e", (F.col("x") != F.col("y")).alias("cross"))
    # posting by posting, as a batch of rows with long lists has no bound in bytes
    lists = lists.repartition("home").sortWithinPartitions("home").select("home", "cross", F.posexplode("e").alias("p", "e")).select("home", "cross", (F.col("p") == 0).alias("first"), "e.*")
    added = lists.mapInArrow(_matches(t, most), "a bigint, b bigint, shared tinyint, matches tinyint")
    return added.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("matches").alias("matches")).filter("shared >= matches").select("a", "b")


def _verified(survivors: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold."""
    home = survivors.select("record", "least", F.size("tokens").alias("n"))
    crowd = home.groupBy("least").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks")).withColumn("blocks", F.greatest(F.lit(1), "blocks"))
    home = settle(home.join(crowd, "least").select("record", F.xxhash64("least", F.pmod("record", "blocks")).alias("home")))
    keyed = pairs.join(home.select(F.col("record").alias("a"), F.col("home").alias("x")), "a").join(home.select(F.col("record").alias("b"), F.col("home").alias("y")), "b")
    keyed = settle(keyed.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("key"), "a", "b"))
    wanted = keyed.select("key", F.explode(F.array("a", "b")).alias("record")).distinct()
    sets = wanted.join(survivors.select("record", "size", "tokens"), "record").select("key", F.lit(0).alias("kind"), F.col("record").alias("a"), F.lit(0).cast("bigint").alias("b"), "size", "tokens")
    rows = sets.union(keyed.select("key", F.lit(1), "a", "b", F.lit(0), F.array().cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, parts = None, {}, []
        for batch in batches:
            key, kind, a, b, size = (batch.column(i).to_numpy() for i in range(5))
            lists = batch.column(5)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            out: list[tuple] = []
            for i in range(len(key)):
                if key[i] != now:
                    now, held, parts = key[i], {}, []
                if not kind[i]:  # the parts of a set follow one another
                    parts.append(values[at[i] : at[i + 1]])
                    if b[i] == 1:
                        held[a[i]] = (np.sort(np.concatenate(parts)), int(size[i]))
                        parts = []
                    continue
                (x, nx), (y, ny) = held[a[i]], held[b[i]]
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if (value := shared / (nx + ny - shared)) >= t - 1e-12:
                    out.append((a[i], b[i], value))
            if out:
                p, q, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.float64())], ["a", "b", "jaccard"])

    # a set comes in parts, the last with b = 1, as a batch of rows with long sets has no bound in bytes
    cut = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(CHUNK)), lambda i: F.slice("tokens", i + 1, CHUNK))
    rows = rows.repartition("key").sortWithinPartitions("key", "kind").select("key", "kind", "a", "b", "size", F.posexplode(F.when(F.size("tokens") > CHUNK, cut).otherwise(F.array("tokens"))).alias("p", "part"), F.size("tokens").alias("n"))
    last = F.when(F.col("kind") == 1, F.col("b")).otherwise((F.col("p") >= F.ceil(F.col("n") / CHUNK) - 1).cast("bigint"))
    return rows.select("key", "kind", "a", last.alias("b"), "size", "part").mapInArrow(run, "a bigint, b bigint, jaccard double")


def record_pairs(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], n: int = N, t: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """(a, b, jaccard) over the records (distinct sets) of docs: the join before copies are spelled out."""
    survivors = settle(_survivors(docs, heavy, n, t, most))
    return _verified(survivors, settle(_candidates(survivors, t, most)), t)


def _joined(docs: DataFrame, n: int, t: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, record, size) and the pairs of records (a, b, jaccard)."""
    if not 0 < t <= 1 or n < 1 or most < 1:
        raise ValueError("0 < t <= 1, n >= 1 and most >= 1 are needed")
    marks, heavy = _marks(docs, n)
    return marks, record_pairs(docs, heavy, n, t, most)


def jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """Every pair of documents whose n-gram sets have a Jaccard similarity of t or more: (doc_a, doc_b, jaccard).

    doc_a < doc_b; each pair comes once, so the result grows with the square of a group of copies (linked() counts the pairs
    instead). A document of fewer than n words has one gram of all its words.
    Documents without id, text or word have no partners. Rows that repeat an id are one document, found
    under each of its texts, never its own partner; the largest similarity of a pair counts. Other columns
    are ignored. An empty table gives no rows.
    """
    marks, pairs = _joined(docs, n, t, most)
    members = marks.groupBy("record").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    same = members.filter(F.size("docs") > 1).select(F.posexplode("docs").alias("p", "doc_a"), "docs")
    same = same.select("doc_a", F.explode(F.slice("docs", F.col("p") + 2, F.size("docs"))).alias("doc_b"), F.lit(1.0).alias("jaccard"))
    near = pairs.join(members.select(F.col("record").alias("a"), F.col("docs").alias("x")), "a").join(members.select(F.col("record").alias("b"), F.col("docs").alias("y")), "b")
    near = near.select(F.explode("x").alias("u"), "y", "jaccard").select("u", F.explode("y").alias("v"), "jaccard").filter("u <> v")
    both = same.union(near.select(F.least("u", "v"), F.greatest("u", "v"), "jaccard"))
    if marks.groupBy("doc_id").agg(F.count_distinct("record").alias("of")).filter("of > 1").isEmpty():  # each pair is there once
        return both.withColumn("jaccard", F.round("jaccard", 6))
    return both.groupBy("doc_a", "doc_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def _classes(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of documents with words: class_id is the least id among the documents that pairs connect, alone its own."""
    labels = components(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), pairs.select("a", "b")).toDF("record", "label")
    named = marks.join(labels, "record", "left").select("doc_id", F.coalesce("label", "record").alias("label"))
    # an id with several texts ties their groups together
    several = named.groupBy("doc_id").agg(F.collect_set("label").alias("of")).filter(F.size("of") > 1)
    ties = settle(several.select(F.array_min("of").alias("a"), F.explode("of").alias("b")).filter("a <> b"))
    if not ties.isEmpty():
        again = components(ties.select(F.col("a").alias("node")).union(ties.select("b")), ties).toDF("label", "over")
        named = named.join(again, "label", "left").select("doc_id", F.coalesce("over", "label").alias("label"))
    named = named.distinct()
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "label").select("doc_id", "class_id")


def _links(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, links) of documents with words: how many other documents reach the threshold with it, copies among them."""
    marks = marks.select("doc_id", "record").distinct()
    near = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("record", "other")
    several = settle(marks.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if several.isEmpty():
        members = settle(marks.groupBy("record").agg(F.count("*").alias("n")))
        around = near.join(members.toDF("other", "n"), "other").groupBy("record").agg(F.sum("n").alias("around"))
        return marks.join(members, "record").join(around, "record", "left").select("doc_id", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("links"))
    # ids with several texts are counted once for each document: their links are spelled out, those of others added up
    near = settle(near.union(marks.select("record", F.col("record").alias("other")).distinct()))
    alone, of = settle(marks.join(several, "doc_id", "left_anti")), settle(marks.join(several, "doc_id"))
    members = settle(alone.groupBy("record").agg(F.count("*").alias("n")))
    around = near.join(members.toDF("other", "n"), "other").groupBy("record").agg(F.sum("n").alias("around"))
    with_several = near.join(of.toDF("doc", "other"), "other").select("record", "doc").distinct()
    count = with_several.groupBy("record").agg(F.count("*").alias("docs"))
    one = alone.join(around, "record", "left").join(count, "record", "left").select("doc_id", (F.coalesce("around", F.lit(0)) + F.coalesce("docs", F.lit(0)) - 1).alias("links"))
    reached = of.join(near, "record").select("doc_id", "other").distinct().join(members.toDF("other", "n"), "other").groupBy("doc_id").agg(F.sum("n").alias("around"))
    reach = of.join(with_several, "record").select("doc_id", "doc").distinct().groupBy("doc_id").agg((F.count("*") - 1).alias("docs"))
    return one.union(reach.join(reached, "doc_id", "left").select("doc_id", F.coalesce("around", F.lit(0)) + F.col("docs")))


def linked(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """(doc_id, class_id, links): one row for each document with an id.

    links counts the other documents whose n-gram sets have a Jaccard similarity of t or more with its own, copies and near copies
    alike; class_id is the least id of the documents that such links connect it to, directly or not. A document of fewer than n
    words has one gram of all its words. Documents without text or word have their own class and no links. Rows that repeat
    an id are one document, found under each of its texts, never its own partner. Rows without id are left out, other
    columns ignored. An empty table gives no rows.
    """
    marks, pairs = _joined(docs, n, t, most)
    pairs = settle(pairs)
    found = _classes(marks, pairs).join(_links(marks, pairs), "doc_id")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def deduplicated(docs: DataFrame, n: int = N, t: float = THRESHOLD, most: int = MOST_MATCHES) -> DataFrame:
    """The rows of docs without those of all but one document of each group: the one of least id stays.

    Of rows that repeat an id one stays, that of least text. Rows without id, and those without words, stay. Columns
    pass, whatever their names.
    """
    marks, pairs = _joined(docs, n, t, most)
    found = settle(_classes(marks, settle(pairs)).filter("doc_id <> class_id").select("doc_id").distinct())
    again = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id")).join(small(found), "doc_id", "left_anti")
    if not again.isEmpty():
        single, several = rows.join(small(again), "doc_id", "left_anti"), rows.join(small(again), "doc_id", "left_semi")
        first = several.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("row.text"))).filter("r = 1").drop("r")
        rows = single.unionByName(first)
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE shared >= {THRESHOLD} * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM j UNION SELECT doc_b, doc_a FROM j),
r(doc_id, now) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.now = e.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, min(now) AS class_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a) l USING (doc_id)
"""
