"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is lines. Each line is observed as a speaker marker and a line feature. Markers are words for roles ("User:", "[AI]", "Q:"),
and names of any kind: one that begins several lines, or is bracketed, is the first, second or a later speaker of its transcript, by
its first line, so names that no training transcript had are observed alike. The line
feature is (length class, ends as a question, begins in capitals, follows a blank line). Hidden states are roles, each with a first line of a turn and
further lines. Probabilities are counted on transcripts whose roles are known; Viterbi finds the states,
and turns are rendered as <|role|>, a line break, the text without marker, <|end|>.

The conversations table has its roles in a column; transcripts() writes it as raw text in several styles of marker, with
markers missing here and there, and query() recovers the roles from that text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.session import settle, table

NAME = "op3_chat"
SQL = None
ROLES = ("system", "user", "assistant")
#: The model is fitted on at most about this many conversations, those of least hash.
MOST_LABELLED = 5_000
#: Speakers of transcripts that name people; the pairs differ from conversation to conversation.
NAMES = ("Alice", "Bob", "Carol", "Dmitri", "Emre", "Fatima", "Grace", "Hiro", "Ines", "Jonas", "Katya", "Liam")
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[ai] "), ("### Instruction: ", "### Human: ", "### Response: "), ("SYSTEM> ", "Q: ", "A: "), ("", "", ""), ("Note: ", "{}: ", "{}: "), ("[Notice] ", "[{}] ", "[{}] "))
_WORDS = {"system": 0, "developer": 0, "instruction": 0, "instructions": 0, "context": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "prompt": 1, "me": 1, "you": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "response": 2, "model": 2, "chatbot": 2, "gpt": 2, "tool": 2, "function": 2}
_MARKER = re.compile(r"\s{0,3}(?:#{1,4}\s*|[-*>]\s*|\*\*)?(?:\[([^\W\d_]{1,20})\]|<\|?([^\W\d_]{1,20})\|?>|([^\W\d_]{1,20})(?:\*\*)?\s?[:>])(?:\*\*)?(?:\s|$)\s{0,3}")
#: Observed markers: those of the roles, the first, second and later speakers by other names, none. Line features: see feature().
N_MARKERS, N_FEATURES = 7, 24
NONE = N_MARKERS - 1
STATES = 2 * len(ROLES)  # first line of role r: r; further line: r + len(ROLES)


def marker(line: str) -> tuple[int, int, str]:
    """(marker, its length, its word): the marker of the role that it names; -2 for another bracketed or hashed word, -1 for another with a colon, NONE for none."""
    m = _MARKER.match(line)
    if not m:
        return NONE, 0, ""
    name = next(x for x in m.groups() if x).lower()
    if name in _WORDS:
        return _WORDS[name], m.end(), name
    return (-2 if m.group(1) or m.group(2) or line.startswith("#") else -1), m.end(), name


def feature(text: str, after_blank: bool) -> int:
    """Length class (3), question (2), small first letter (2), after a blank line or at the start (2)."""
    n = len(text)
    return (((0 if n < 40 else 1 if n < 160 else 2) * 2 + text.rstrip().endswith("?")) * 2 + text[:1].islower()) * 2 + after_blank


def observe(transcript: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(lines that aren't blank, markers, lengths of the markers, features); blank lines between are kept in front of the next line."""
    lines, marks, cuts, names, blanks, blank, held = [], [], [], [], [], True, ""
    for line in transcript.split("\n"):
        if not line.strip():
            blank, held = True, held + line + "\n"
            continue
        kind, cut, name = marker(line)
        lines.append(held + line if lines else line)
        marks.append(kind)
        cuts.append(cut)
        names.append(name)
        blanks.append(blank)
        blank, held = False, ""
    often = Counter(n for n, k in zip(names, marks, strict=True) if k < 0)
    speakers: dict[str, int] = {}
    for i, (kind, name) in enumerate(zip(marks, names, strict=True)):
        if kind < 0:  # a word with a colon that comes once is text
            known = kind == -2 or often[name] > 1
            marks[i] = len(ROLES) + min(2, speakers.setdefault(name, len(speakers))) if known else NONE
            cuts[i] = cuts[i] if known else 0
    feats = [feature(line.lstrip("\n")[cut:], blank) for line, cut, blank in zip(lines, cuts, blanks, strict=True)]
    return lines, np.array(marks, int), np.array(cuts, int), np.array(feats, int)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # STATES x (N_MARKERS * N_FEATURES), log probabilities


def model_of(start: np.ndarray, step: np.ndarray, mark: np.ndarray, feat: np.ndarray) -> Model:
    """Log probabilities from counts; further lines lead to further lines of their role or to a first line."""
    allowed = np.zeros((STATES, STATES), bool)
    allowed[:, : len(ROLES)] = True
    for r in range(len(ROLES)):
        allowed[r, r + len(ROLES)] = allowed[r + len(ROLES), r + len(ROLES)] = True
    with np.errstate(divide="ignore"):
        s = np.where(np.arange(STATES) < len(ROLES), start + 1.0, 0)
        t = np.where(allowed, step + 0.5, 0)
        m, f = mark + 0.2, feat + 0.5
        m, f = (np.log(x / x.sum(axis=1, keepdims=True)) for x in (m, f))
        return Model(np.log(s / s.sum()), np.log(t / t.sum(axis=1, keepdims=True)), (m[:, :, None] + f[:, None, :]).reshape(STATES, -1))


def viterbi(observed: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """The best states of each sequence of observations; all sequences go forward together."""
    order = np.argsort([-len(x) for x in observed], kind="stable")
    lengths = np.array([len(observed[i]) for i in order])
    longest = int(lengths.max(initial=0))
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # sequences longer than t
    backs, scores = [], np.zeros((len(order), STATES))
    flat = [np.array([observed[i][t] for i in order[: live[t]]]) for t in range(longest)] if longest < 64 else None
    for t in range(longest):
        k = live[t]
        seen = flat[t] if flat else np.fromiter((observed[i][t] for i in order[:k]), int, k)
        e = model.emit[:, seen].T
        if t == 0:
            scores[:k] = model.start + e
            backs.append(None)
            continue
        by = scores[:k, :, None] + model.step
        back = by.argmax(axis=1)
        scores[:k] = np.take_along_axis(by, back[:, None, :], axis=1)[:, 0] + e
        backs.append(back.astype(np.int8))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(observed)
    state, paths = np.zeros(len(order), int), [np.zeros(n, int) for n in lengths]
    for t in range(longest - 1, -1, -1):
        k, upto = live[t], live[t + 1] if t + 1 < longest else 0
        state[upto:k] = scores[upto:k].argmax(axis=1)
        for j in range(k):
            paths[j][t] = state[j]
        if t:
            state[:k] = backs[t][np.arange(k), state[:k]]
    for i, p in zip(order, paths, strict=True):
        out[i] = p
    return out


def turns(lines: list[str], cuts: np.ndarray, states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    found: list[tuple[str, list[str]]] = []
    for line, cut, state in zip(lines, cuts.tolist(), states.tolist(), strict=True):
        if state < len(ROLES):
            found.append((ROLES[state], [line.lstrip("\n")[cut:]]))
        else:
            found[-1][1].append(line)
    return [(role, "\n".join(text).strip()) for role, text in found]


def escaped(text: str) -> str:
    """Text in which nothing reads as a turn's frame."""
    return text.replace("<|", "<​|")


def render(found: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{escaped(text)}\n<|end|>" for role, text in found)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, transcript, roles): each conversation as raw text, one turn after another, and the true role of each line that isn't blank.

    Markers are of a style by the id's hash; one turn in six has none. A role is that of its word (human is user, tool assistant).
    Turns without id, role or text are left out, those of roles without a word too; turns of one number go by role and text.
    roles has for each line 0 to 5, a state.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.lower("role").alias("role"), F.col("text").cast("string").alias("text"))
    known = F.create_map(*(F.lit(x) for w, r in _WORDS.items() for x in (w, ROLES[r])))
    rows = rows.withColumn("role", known[F.col("role")]).filter(F.col("conv_id").isNotNull() & F.col("role").isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    mark = F.array(*(F.array(*map(F.lit, s)) for s in STYLES))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(len(NAMES))) + role * 5).cast("int") % len(NAMES) + 1)
    silent = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0
    rows = rows.select("conv_id", "turn", role.alias("r"), "text", F.when(silent, F.lit("")).otherwise(F.replace(F.element_at(F.element_at(mark, style + 1), role + 1), F.lit("{}"), name)).alias("mark"), style.alias("style"))
    ordered = rows.groupBy("conv_id", "style").agg(F.sort_array(F.collect_list(F.struct("turn", "r", "text", "mark"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["mark"], F.trim(F.regexp_replace(x["text"], r"^\s+|\s+$", "")))), "\n\n")
    joined = F.when(F.col("style") % 2 == 0, joined).otherwise(F.array_join(F.transform("t", lambda x: F.concat(x["mark"], F.trim(F.regexp_replace(x["text"], r"^\s+|\s+$", "")))), "\n"))
    filled = lambda x: F.size(F.filter(F.split(F.regexp_replace(x["text"], r"^\s+|\s+$", ""), "\n"), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")) != ""))
    states = F.flatten(F.transform("t", lambda x: F.concat(F.array(x["r"]), F.array_repeat(x["r"] + len(ROLES), filled(x) - 1))))
    return ordered.select("conv_id", joined.alias("transcript"), states.alias("roles"))


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Counts on (conv_id, transcript, roles). Without any rows the model knows only that markers name roles."""
    n = labelled.count()
    own = labelled if n <= most else labelled.filter(F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(1 << 32)) < int(most / n * (1 << 32)))
    shapes = ((STATES,), (STATES, STATES), (STATES, N_MARKERS), (STATES, N_FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, mark, feat = (np.zeros(s, np.int64) for s in shapes)
        for batch in batches:
            for text, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, m, _, f = observe(text)
                s = np.array(roles)
                if len(s) != len(m) or not len(s):
                    continue
                start[s[0]] += 1
                np.add.at(step, (s[:-1], s[1:]), 1)
                np.add.at(mark, (s, m), 1)
                np.add.at(feat, (s, f), 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in (start, step, mark, feat)])])], ["counts"])

    sizes = [int(np.prod(s)) for s in shapes]
    counts = np.zeros(sum(sizes))
    for r in own.select("transcript", "roles").mapInArrow(run, "counts array<bigint>").toArrow().column("counts").to_pylist():
        counts += r
    start, step, mark, feat = (x.reshape(s) for x, s in zip(np.split(counts, np.cumsum(sizes)[:-1]), shapes, strict=True))
    for r in range(len(ROLES)):  # a marker names its role
        mark[r, r] += 2
    return model_of(start, step, mark, feat)


def parse(raw: DataFrame, model: Model) -> DataFrame:
    """(conv_id, n_turns, roles, rendered) of raw transcripts (conv_id, transcript).

    roles are the turns' roles, first letters. A null, empty or blank transcript has no turns and renders as "". Rows that
    repeat an id are parsed one by one. Frames in the text itself are broken by a zero-width space. Other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                b = batch.slice(low, 500)
                seen = [observe(t or "") for t in b.column(1).to_pylist()]
                states = viterbi([m * N_FEATURES + f for _, m, _, f in seen], model)
                found = [turns(lines, cuts, s) for (lines, _, cuts, _), s in zip(seen, states, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array(["".join(r[0] for r, _ in x) for x in found], pa.string()), pa.array([render(x) for x in found], pa.string())], ["conv_id", "n_turns", "roles", "rendered"])

    return raw.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("transcript").cast("string").alias("transcript")).mapInArrow(run, "conv_id bigint, n_turns int, roles string, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = settle(transcripts(table(spark, sf_dir, "conversations")))
    return parse(raw, train(raw))
