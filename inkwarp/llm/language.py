"""Language identification of spans in mixed-language text.

A word is of one script: a run of letters and digits ends at signs, ASCII or not, and where the script changes. A word's script leaves the languages that are written in it; words of a script with one language have that. Among
several, languages are scored by the character n-grams of the word (1 to 4, with marks for its ends), and Viterbi over the
scores of the words, with a penalty for each switch, finds the best labels; equal labels in a row are a span. Scripts that share a
language (Serbian is written in two) are solved together, so that staying in it is free where the script changes; a switch costs the
same between any two languages, so runs of scripts that share none can be solved by themselves. All
runs of a batch are solved together: in stretches of STRETCH words as max-plus matrices, then over stretches, then back.

Scores are log probabilities of a multinomial model with hashed n-grams, counted on documents with a language label (a
bounded sample, see MOST_LABELLED).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.llm.words import _BYTE, _powers, buffers, mix, slices, words
from inkwarp.session import spread, table

NAME = "op9_language"
SQL = None
#: The scores are fitted on at most about this many labelled documents, those of least hash.
MOST_LABELLED = 5_000
#: A language is a candidate of the scripts that have this share of its own words or more.
MAIN = 0.1
SLOTS, LONGEST, PENALTY, STRETCH, SLICE = 1 << 17, 4, 25.0, 64, 2_000_000
#: First code point of a script, the script, and its language where labels tell none.
_SCRIPTS = [
    (0, "latin", "und"), (0x370, "greek", "el"), (0x400, "cyrillic", "ru"), (0x530, "armenian", "hy"), (0x590, "hebrew", "he"), (0x600, "arabic", "ar"), (0x700, "syriac", "syr"), (0x750, "arabic", "ar"), (0x780, "thaana", "dv"), (0x7C0, "nko", "nqo"), (0x800, "other", "und"), (0x860, "arabic", "ar"), (0x900, "devanagari", "hi"), (0x980, "bengali", "bn"), (0xA00, "gurmukhi", "pa"), (0xA80, "gujarati", "gu"), (0xB00, "oriya", "or"), (0xB80, "tamil", "ta"), (0xC00, "telugu", "te"), (0xC80, "kannada", "kn"), (0xD00, "malayalam", "ml"), (0xD80, "sinhala", "si"), (0xE00, "thai", "th"), (0xE80, "lao", "lo"), (0xF00, "tibetan", "bo"), (0x1000, "myanmar", "my"),
    (0x10A0, "georgian", "ka"), (0x1100, "hangul", "ko"), (0x1200, "ethiopic", "am"), (0x13A0, "cherokee", "chr"), (0x1400, "aboriginal", "iu"), (0x1680, "other", "und"), (0x1780, "khmer", "km"), (0x1800, "mongolian", "mn"), (0x18B0, "aboriginal", "iu"), (0x1900, "other", "und"), (0x1C80, "cyrillic", "ru"), (0x1C90, "georgian", "ka"), (0x1CC0, "other", "und"), (0x1D00, "latin", "und"), (0x1F00, "greek", "el"), (0x2000, "other", "und"), (0x2C60, "latin", "und"), (0x2C80, "other", "und"), (0x2D00, "georgian", "ka"), (0x2D30, "tifinagh", "zgh"), (0x2D80, "ethiopic", "am"), (0x2DE0, "cyrillic", "ru"), (0x2E00, "other", "und"), (0x2E80, "han", "zh"), (0x2FE0, "other", "und"),
    (0x3040, "kana", "ja"), (0x3100, "han", "zh"), (0x3130, "hangul", "ko"), (0x3190, "other", "und"), (0x31A0, "han", "zh"), (0x31F0, "kana", "ja"), (0x3200, "other", "und"), (0x3400, "han", "zh"), (0xA000, "yi", "ii"), (0xA4D0, "other", "und"), (0xA640, "cyrillic", "ru"), (0xA6A0, "other", "und"), (0xA720, "latin", "und"), (0xA800, "other", "und"), (0xA8E0, "devanagari", "hi"), (0xA900, "other", "und"), (0xA960, "hangul", "ko"), (0xA980, "other", "und"), (0xAB00, "ethiopic", "am"), (0xAB30, "latin", "und"), (0xAB70, "cherokee", "chr"), (0xABC0, "other", "und"), (0xAC00, "hangul", "ko"), (0xD800, "other", "und"), (0xF900, "han", "zh"), (0xFB00, "latin", "und"), (0xFB13, "armenian", "hy"), (0xFB1D, "hebrew", "he"), (0xFB50, "arabic", "ar"), (0xFE00, "other", "und"), (0xFE70, "arabic", "ar"), (0xFF00, "other", "und"), (0xFF21, "latin", "und"), (0xFF66, "kana", "ja"), (0xFFA0, "hangul", "ko"), (0xFFE0, "other", "und"), (0x20000, "han", "zh"), (0x32000, "other", "und"),
]
_STARTS = np.array([s for s, _, _ in _SCRIPTS])
SCRIPTS = sorted({s for _, s, _ in _SCRIPTS})
_SCRIPT = np.array([SCRIPTS.index(s) for _, s, _ in _SCRIPTS])
BREAK, COMMON = -1, -2
_SINGLE = {s: lang for _, s, lang in reversed(_SCRIPTS)}


@dataclass
class Model:
    """languages[script]: the candidates of a script; scores[script]: SLOTS x candidates, where there are several."""

    languages: dict[str, list[str]]
    scores: dict[str, np.ndarray]


def _classes() -> np.ndarray:
    """What each code point is: its script for a letter, COMMON for digits, marks and joiners, BREAK for signs and blanks."""
    code = np.arange(0x32000)
    out = _SCRIPT[np.searchsorted(_STARTS, code, "right") - 1].astype(np.int8)
    kinds = np.array([unicodedata.category(chr(c))[0] if unicodedata.category(chr(c)) != "Cf" else "M" for c in code])
    out[np.isin(kinds, ["P", "S", "Z"]) | (kinds == "C") & (code < 0xA0)] = BREAK
    out[np.isin(kinds, ["M", "N"])] = COMMON
    out[0x3007] = SCRIPTS.index("han")
    return out


_CLASS = _classes()


def _cut(data: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first, end, row, script) of the pieces of runs with characters beyond ASCII: signs part them, and so do changes of script.

    Digits, marks and joiners belong to the letters before them, those that open a run to the letters after. Han characters
    in a run with kana are of its script.
    """
    length = end - first
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin - first, length)
    run = np.repeat(np.arange(len(first)), length)
    lead = (data[at] & 0xC0) != 0x80
    at, run = at[lead], run[lead]
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    a, b, c, d = (padded[at + i].astype(np.int32) for i in range(4))
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    stop = np.append(np.where(run[1:] == run[:-1], at[1:], end[run[:-1]]), end[run[-1]])
    kind = _CLASS[np.minimum(code, len(_CLASS) - 1)]
    part = kind == BREAK
    new = np.concatenate([[True], (run[1:] != run[:-1]) | part[:-1]]) | part
    run = np.cumsum(new) - 1
    i = np.arange(len(at))
    known = np.maximum.accumulate(np.where(new | (kind >= 0), i, 0))
    script = kind[known]
    close = np.append(new[1:], True)
    after = np.minimum.accumulate(np.where(close | (kind >= 0), i, len(at))[::-1])[::-1]
    script = np.where(script == COMMON, kind[after], script)
    kana, han = SCRIPTS.index("kana"), SCRIPTS.index("han")
    script = np.where((script == han) & (np.bincount(run[script == kana], minlength=run[-1] + 1) > 0)[run], kana, script)
    new[1:] |= script[1:] != script[:-1]
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(at)) - 1
    ok = script[low] >= 0
    low, high = low[ok], high[ok]
    first, end = at[low], stop[high]
    row = row[np.searchsorted(begin, np.searchsorted(np.cumsum(lead), low + 1), "right") - 1]
    if not len(low):
        return np.zeros(0, np.uint64), first, end, row, script[low].astype(np.int64)
    length = end - first
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _BYTE[data[place + np.repeat(first, length)]] * _powers(max(2, int(length.max())))[place]
    return mix(np.add.reduceat(value, begin) ^ length.astype(np.uint64)), first, end, row, script[low].astype(np.int64)


def _ngrams(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of all character n-grams of the words. A word is taken with a mark before and after it."""
    length = end - first + 2
    begin = np.cumsum(length) - length
    total = int(length.sum())
    chars = np.full(total, 1, np.uint64)
    inside = np.ones(total, bool)
    inside[begin] = inside[begin + length - 1] = False
    word = np.repeat(np.arange(len(first)), length)
    chars[inside] = data[(np.arange(total) - begin[word] - 1 + first[word])[inside]]
    lead = (chars & np.uint64(0xC0)) != np.uint64(0x80)  # n-grams begin at characters; bytes stand for them
    slots, owners = [], []
    h = np.zeros(total, np.uint64)
    for n in range(1, LONGEST + 2):
        h[: total - n + 1] = (h[: total - n + 1] + chars[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n == 1:
            continue
        ok = lead[: total - n + 1] & (word[: total - n + 1] == word[n - 1 :])
        slots.append((mix(h[: total - n + 1][ok]) & np.uint64(SLOTS - 1)).astype(np.int64))
        owners.append(word[: total - n + 1][ok])
    return np.concatenate(slots), np.concatenate(owners)


def _split(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(lower-case bytes, hash, first, end, row, script) of the words of a column; digits alone are no words."""
    data, at = buffers(pc.utf8_lower(column))
    h, first, end, row = words(data, at)
    if len(h):
        letters = np.concatenate([[0], np.cumsum(~((data >= 48) & (data <= 57)) & ((data >= 128) | (data >= 97) & (data <= 122)))])
        ok = letters[end] > letters[first]
        h, first, end, row = h[ok], first[ok], end[ok], row[ok]
    script = np.full(len(h), SCRIPTS.index("latin"))
    beyond = np.concatenate([[0], np.cumsum(data >= 128)])
    cut = beyond[end] > beyond[first]
    if cut.any():
        parts = _cut(data, first[cut], end[cut], row[cut])
        h, first, end, row, script = (np.concatenate([x[~cut], y]) for x, y in zip((h, first, end, row, script), parts, strict=True))
        order = np.argsort(first, kind="stable")
        h, first, end, row, script = h[order], first[order], end[order], row[order], script[order]
    return data, h, first, end, row, script


def train(docs: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Scores of languages from documents with text and label, of each language as many as of others or all it has.

    A script's candidates are the languages with MAIN of their own words in it, however few documents they have; a script that no
    label is written in has its usual language (_SCRIPTS), those of Unicode that aren't listed "und". Counts are smoothed with the mean of the
    candidates, so that a language with few documents has no gain from what it was never seen with.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    have = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if sum(have.values()) > most:
        left, quota = most, 0.0
        for k, n in enumerate(sorted(have.values())):
            quota = left / (len(have) - k)
            if n >= quota:
                break
            left -= n
        parts = [(x, int(min(1.0, quota / n) * (1 << 32))) for x, n in have.items()]
        own = own.join(F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, part bigint")), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        count: dict[tuple[str, int], int] = {}
        for batch in slices(batches, 1):
            data, _, first, end, row, script = _split(batch.column(1))
            if not len(first):
                continue
            names, of = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            slot, word = _ngrams(data, first, end)
            key = of[row] * len(SCRIPTS) + script
            for k in np.unique(key):
                at = (str(names[k // len(SCRIPTS)]), int(k % len(SCRIPTS)))
                sums[at] = sums.get(at, 0) + np.bincount(slot[key[word] == k], minlength=SLOTS)
                count[at] = count.get(at, 0) + int((key == k).sum())
        for (lang, script), v in sums.items():
            there = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([lang], [script], [count[lang, script]], [there.astype(np.int32).tobytes()], [v[there].astype(np.int64).tobytes()])], ["lang", "script", "n", "slots", "counts"])

    counted: dict[int, dict[str, np.ndarray]] = {}
    size: dict[int, dict[str, int]] = {}
    for r in own.select("lang", "text").mapInArrow(run, "lang string, script bigint, n bigint, slots binary, counts binary").toLocalIterator():
        v = counted.setdefault(r["script"], {}).setdefault(r["lang"], np.zeros(SLOTS))
        v[np.frombuffer(r["slots"], np.int32)] += np.frombuffer(r["counts"], np.int64)
        size.setdefault(r["script"], {}).setdefault(r["lang"], 0)
        size[r["script"]][r["lang"]] += r["n"]
    languages, scores = {}, {}
    for i, script in enumerate(SCRIPTS):
        own_size = size.get(i, {})
        langs = sorted(x for x, n in own_size.items() if n >= MAIN * sum(v.get(x, 0) for v in size.values()))
        languages[script] = langs or [_SINGLE[script]]
        if len(langs) > 1:
            p = np.stack([counted[i][x] for x in langs], axis=1)
            mean = (p / p.sum(axis=0)).mean(axis=1, keepdims=True) + 1e-3 / SLOTS
            p = np.log((p + 0.5 * SLOTS * mean) / (p.sum(axis=0) + 0.5 * SLOTS))
            scores[script] = (p - p.mean(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, scores)


def viterbi(score: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: score is words x labels, runs start at begin. Of equal paths the one that stays, then the least label."""
    n, m = score.shape
    length = np.diff(np.append(begin, n))
    stretches = -(-length // STRETCH)
    total = int(stretches.sum())
    run = np.repeat(np.arange(len(begin)), stretches)
    first = np.cumsum(stretches) - stretches
    inner = np.arange(total) - first[run]
    s = np.zeros((STRETCH, total, m), np.float32)  # padding scores 0 and changes nothing
    of = np.repeat(np.arange(len(begin)), length)
    at = np.arange(n) - begin[of]
    where = first[of] + at // STRETCH
    s[at % STRETCH, where] = score
    # best score from label a before a stretch to label b at its end
    path = np.full((total, m, m), -np.inf, np.float32)
    path[:, range(m), range(m)] = 0
    for t in range(STRETCH):
        path = np.maximum(path, path.max(axis=2, keepdims=True) - penalty) + s[t][:, None, :]
    entry = np.zeros((total, m), np.float32)  # best scores before each stretch
    order = np.argsort(inner, kind="stable")
    ends = np.searchsorted(inner[order], np.arange(int(stretches.max(initial=0)) + 1))
    for k in range(1, len(ends) - 1):
        now = order[ends[k] : ends[k + 1]]
        before = entry[now - 1]
        after = (before[:, :, None] + path[now - 1]).max(axis=1)
        entry[now] = after - after.max(axis=1, keepdims=True)
    # forward again, with choices; at the first word of a run any label is free
    back = np.zeros((STRETCH, total, m), np.int8)
    d = entry
    for t in range(STRETCH):
        top = d.argmax(axis=1)
        jump = np.take_along_axis(d, top[:, None], axis=1) - penalty
        stay = d >= jump
        if t == 0:
            stay[inner == 0] = True
        back[t] = np.where(stay, np.arange(m), top[:, None])
        d = np.where(stay, d, jump) + s[t]
    label = np.zeros((STRETCH, total), np.int8)
    home = np.broadcast_to(np.arange(m), (total, m)).copy()
    for t in range(STRETCH - 1, -1, -1):
        home = np.take_along_axis(back[t].astype(np.int64), home, axis=1)
    final = np.zeros(total, np.int64)
    last = first + stretches - 1
    final[last] = d[last].argmax(axis=1)
    for k in range(len(ends) - 2, 0, -1):
        now = order[ends[k] : ends[k + 1]]
        final[now - 1] = home[now, final[now]]
    at_label = final
    for t in range(STRETCH - 1, -1, -1):
        label[t] = at_label
        at_label = np.take_along_axis(back[t].astype(np.int64), at_label[:, None], axis=1)[:, 0]
    return label[at % STRETCH, where].astype(np.int64)


def _together(model: Model) -> list[list[int]]:
    """The scripts, those that share a language in one list."""
    found: list[tuple[set[str], list[int]]] = []
    for i, script in enumerate(SCRIPTS):
        langs, own = set(model.languages[script]) - {"und"}, [i]
        for other in [x for x in found if x[0] & langs]:
            found.remove(other)
            langs, own = langs | other[0], own + other[1]
        found.append((langs, own))
    return [own for _, own in found]


def _labels(data: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray, script: np.ndarray, model: Model, names: dict[str, int], penalty: float) -> np.ndarray:
    """The language of each word, by its number in names."""
    out = np.zeros(len(h), np.int64)
    there = np.bincount(script, minlength=len(SCRIPTS)) > 0
    for scripts in _together(model):
        scripts = [i for i in scripts if there[i]]
        langs = sorted({x for i in scripts for x in model.languages[SCRIPTS[i]]})
        own = np.flatnonzero(np.isin(script, scripts))
        if len(langs) == 1:
            out[own] = names[langs[0]]
        if len(langs) < 2:
            continue
        score = np.full((len(own), len(langs)), -2000.0, np.float32)  # of languages that aren't written so
        for i in scripts:
            at, some = np.flatnonzero(script[own] == i), [langs.index(x) for x in model.languages[SCRIPTS[i]]]
            if len(some) == 1:
                score[at, some[0]] = 0
                continue
            _, one, back = np.unique(h[own[at]], return_index=True, return_inverse=True)
            slot, word = _ngrams(data, first[own[at[one]]], end[own[at[one]]])
            order = np.argsort(word, kind="stable")
            begin = np.searchsorted(word[order], np.arange(len(one)))
            score[np.ix_(at, some)] = np.add.reduceat(model.scores[SCRIPTS[i]][slot[order]], begin)[back]
        starts = np.flatnonzero(np.concatenate([[True], (row[own][1:] != row[own][:-1]) | (np.diff(own) != 1)]))
        out[own] = np.array([names[x] for x in langs])[viterbi(score, starts, penalty)]
    return out


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, span, lang, start, end, words): spans of one language, in order; start and end count characters, end excluded.

    A span goes from its first word to its last. A text without words (null, empty, signs or digits only) has one span of
    language "und" without place. Rows that repeat an id, and those without id, are labelled one by one. Other columns are
    ignored. An empty table gives no rows.
    """
    every = sorted({x for v in model.languages.values() for x in v})
    names = {x: i for i, x in enumerate(every)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            data, h, first, end, row, script = _split(batch.column(1))
            if not len(h):
                n = batch.num_rows
                out = [batch.column(0), pa.array(np.zeros(n, np.int32)), pa.array(["und"] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "span", "lang", "start", "end", "words"])
                continue
            label = _labels(data, h, first, end, row, script, model, names, penalty)
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
            last = np.append(new[1:], len(row)) - 1
            _, at = buffers(pc.utf8_lower(batch.column(1)))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            of = row[new]
            base = chars[at[of]]
            empty = np.setdiff1d(np.arange(batch.num_rows), of)
            k, e = len(new), len(empty)
            number = np.arange(k) - np.searchsorted(of, of)
            langs = pa.array(every).take(pa.array(label[new]))
            none = pa.nulls(e, pa.int64())
            out = [
                batch.column(0).take(pa.array(np.concatenate([of, empty]))),
                pa.array(np.concatenate([number, np.zeros(e, np.int64)]).astype(np.int32)),
                pa.concat_arrays([langs, pa.array(["und"] * e, pa.string())]),
                pa.concat_arrays([pa.array(chars[first[new]] - base), none]),
                pa.concat_arrays([pa.array(chars[end[last]] - base), none]),
                pa.array(np.concatenate([last - new + 1, np.zeros(e, np.int64)])),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "span", "lang", "start", "end", "words"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, span int, lang string, start bigint, end bigint, words bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return spans(docs, train(docs))
