"""Surrogate generation for personal data and secrets.

Detected entities are replaced by keyed surrogates of the same type, format, script, gender and length: digits
stay digits and letters letters of their case and script, signs, country codes, issuers, services and public suffixes stay; card numbers with a right
check digit keep one; addresses stay addresses. Names (also in capitals, with apostrophes, after particles) that a title announces are replaced name by name, and so are all
other mentions of these words in the same text, with endings of the gender that the titles tell. A name has one gender in
all documents, that of its titles if they agree. An entity's surrogate depends on the key, its type and
its normal form alone, so all its mentions in all documents get the same one (coreference). Surrogates
of all distinct entities are compared: where two are alike, or one is an entity of the corpus, all but the
first try again with the next attempt, up to ATTEMPTS. Those left get unused surrogates of their format one by one, or longer
ones where there are none, so that all are distinct.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.llm.words import slices
from inkwarp.session import settle, spread, table

NAME = "op7_pii"
SQL = None
KEY = b"inkwarp surrogates"
#: Surrogates that need another attempt go to the tasks with the function up to this many, beyond by a join.
SHIPPED = 50_000
#: Attempts of an entity before unused surrogates are listed.
ATTEMPTS = 50

_TITLES = {
    **dict.fromkeys(["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Signor", "господин", "Господин", "г-н"], "m"),
    **dict.fromkeys(["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Signora", "госпожа", "Госпожа", "г-жа"], "f"),
    **dict.fromkeys(["Dr", "Prof", "Professor"], ""),
}
_UP, _LOW = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ", "a-zß-öø-ÿα-ωά-ώа-яё"
#: A name's word: Smith, McDonald, O'Brien, Smith-Jones or SMITH; particles may stand before it.
_ONE = rf"(?:[{_UP}]['’])?(?:[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?|[{_UP}]{{2,}}(?![{_LOW}]))"
_WORD = rf"{_ONE}(?:-{_ONE})*"
_PARTICLES = "(?:(?:von|van|zu|zur|vom|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|bin|al) ){0,3}"
#: Beginnings of tokens that services give out; they stay.
_PREFIX = r"gh[pousr]_|github_pat_|glpat-|sk-(?:proj-|ant-)?|xox[abprs]-|AIza|hf_|npm_"
_KEYWORDS = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
_TITLED = "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![\w.+-])\w[\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])",
    "secret": rf"(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|(?<![\w-])(?:{_PREFIX})(?=[\w-]{{0,200}}\d)[\w-]{{16,}}(?![\w-])|(?<![A-Za-z0-9]){_KEYWORDS}\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<given>(?=[^\s\"',;]{{0,200}}\d)[^\s\"',;]{{6,}})|(?<![A-Za-z0-9]){_KEYWORDS}\s?=\s?[\"'](?P<quoted>[^\s\"']{{8,}})(?=[\"'])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[3-6]\d{12,18}|[3-6]\d{3}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "name": rf"(?<!\w)(?:{_TITLED})\.? {_PARTICLES}{_WORD}(?: {_PARTICLES}{_WORD}){{0,2}}",
}
_RULES = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: What a text with any entity has; for RE2, which passes over columns quickly.
_HINT = rf"[0-9]|@|AKIA|{_KEYWORDS}|(?:{_TITLED})\.? (?:[^ -@\[-\x60a-z]|(?:vo|va|zu|de|di|d|la|le|te|bi|al)[a-z]{{0,4}} )"
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστ"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
_ENDINGS = {"latin": ("n", "a"), "cyrillic": ("н", "а"), "greek": ("ς", "α")}


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{value}\0{attempt}\0{block}".encode(), key=key[:64], digest_size=64).digest()
        block += 1


def luhn(digits: str) -> bool:
    """Whether a card number's check digit is right."""
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


_SCRIPTS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _alphabet(c: str, hexadecimal: bool = False) -> str:
    """What may stand for a character: a letter of its case and script (of Latin without marks), a digit, a sign itself."""
    if c.isascii():
        return "0123456789" if c.isdigit() else c if not c.isalpha() else ("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz") if c.islower() else ("ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if not c.isalpha():
        return c
    if "一" <= c <= "鿿":
        return "".join(map(chr, range(0x4E00, 0x4F00)))
    letters = _SCRIPTS.get(_script(c), "abcdefghijklmnopqrstuvwxyz")
    return letters.upper() if c.isupper() else letters


def _letters(text: str, draw: Iterator[int], hexadecimal: bool = False) -> str:
    return "".join(x if len(x := _alphabet(c, hexadecimal)) == 1 else x[next(draw) % len(x)] for c in text)


def _script(word: str) -> str:
    first = word[0].lower()
    return "cyrillic" if "а" <= first <= "я" or first == "ё" else "greek" if "α" <= first <= "ω" or "ά" <= first <= "ώ" else "latin"


def _places(word: str, gender: str) -> list[str]:
    """What may stand at each place of a name's surrogate: consonants and vowels by turns in each part, case as it was, the last part's end of the gender."""
    out: list[str] = []
    parts = re.split("([-'’])", word)
    for j, part in enumerate(parts):
        if not part or part in "-'’":
            out += part
            continue
        script = _script(part)
        own = [(_VOWELS if i % 2 else _CONSONANTS)[script] for i in range(len(part))]
        if gender and len(own) > 2:
            own[-1] = _ENDINGS[script][gender == "f"]
        out += [x.upper() if c.isupper() else x for x, c in zip(own, part, strict=True)]
    return out


def _name(word: str, gender: str, draw: Iterator[int]) -> str:
    return "".join(x if len(x) == 1 else x[next(draw) % len(x)] for x in _places(word, gender))


def _normal(word: str) -> str:
    """A name in capitals as it is written otherwise: SMITH is Smith."""
    return "".join(p.capitalize() for p in re.split("([-'’])", word)) if len(word) > 1 and word.isupper() else word


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The replacement of a normal form; kind is that of PATTERNS, with the gender for names ("name:f"), which tells the ending alone."""
    draw = _stream(key, kind.split(":")[0], value, attempt)
    if kind.startswith("name"):
        return _name(value, kind[5:], draw)
    if kind == "email":
        at = value.rindex(".")
        return _letters(value[:at], draw) + value[at:]
    if kind == "ip":
        # same number of digits in each part, never the same parts
        parts = []
        for p in value.split("."):
            low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[len(p)]
            parts.append(str(low + (next(draw) * 256 + next(draw)) % (high - low + 1)))
        return ".".join(parts)
    if kind == "card":
        digits = [c for c in value if c.isdigit()]
        new = digits[0] + "".join(str(next(draw) % 10) for _ in digits[1:])
        if luhn("".join(digits)):
            new = next(new[:-1] + str(d) for d in range(10) if luhn(new[:-1] + str(d)))
        feed = iter(new)
        return "".join(next(feed) if c.isdigit() else c for c in value)
    if kind == "phone" and value[0] == "+":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value).group()
        return code + _letters(value[len(code) :], draw)
    if kind == "iban":
        return value[:2] + _letters(value[2:], draw)
    if kind == "secret" and value.startswith("AKIA"):
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(draw) % 32] for _ in value[4:])
    if kind == "ip6" or kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return _letters(value, draw, True)
    keep = _kept(kind, value)
    return value[:keep] + _letters(value[keep:], draw)


def _kept(kind: str, value: str) -> int:
    """Characters of a secret's beginning that tell the service."""
    m = re.match(_PREFIX, value) if kind == "secret" else None
    return m.end() if m else 0


def _space(kind: str, form: str) -> tuple[tuple[str, ...], ...]:
    """What may stand at each place of a surrogate in the format of form."""
    if kind.startswith("name"):
        return tuple(map(tuple, _places(form, kind[5:])))
    if kind == "ip":
        parts = [tuple(map(str, {1: range(1, 10), 2: range(10, 100), 3: range(100, 255)}[len(p)])) for p in form.split(".")]
        return (parts[0], *(x for p in parts[1:] for x in ((".",), p)))
    low, high = 0, len(form)
    if kind == "email":
        high = form.rindex(".")
    elif kind == "card":
        low = 1
    elif kind == "phone" and form[0] == "+":
        low = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", form).end()
    elif kind == "iban":
        low = 2
    elif kind == "secret" and form.startswith("AKIA"):
        return (*"AKIA", *[tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")] * (len(form) - 4))
    else:
        low = _kept(kind, form)
    hexadecimal = kind == "ip6" or kind == "secret" and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form))
    return tuple(tuple(_alphabet(c, hexadecimal)) if low <= i < high else (c,) for i, c in enumerate(form))


def _longer(kind: str, form: str) -> str:
    """A form with one more place."""
    if kind.startswith("name"):
        return form + form[-1]
    if kind == "email":
        return form.replace("@", "0@", 1)
    if kind == "ip":
        parts = form.split(".")
        i = next((i for i, p in enumerate(parts) if len(p) < 3), None)
        if i is None:
            raise ValueError("more addresses than there are")
        return ".".join([*parts[:i], parts[i] + "0", *parts[i + 1 :]])
    if kind == "ip6":
        parts = form.split(":")
        i = next((i for i, p in enumerate(parts) if 0 < len(p) < 4), None)
        if i is None:
            raise ValueError("more addresses than there are")
        return ":".join([*parts[:i], parts[i] + "0", *parts[i + 1 :]])
    return form + "0"


def _free(rows: list[tuple[str, str, str]], used: set[str], key: bytes) -> list[str | None]:
    """An unused surrogate for each (kind, value, form), in a keyed order of those of the form; None where none is left."""
    lists: dict[tuple, Iterator[str]] = {}
    out: list[str | None] = []
    for kind, value, form in rows:
        check = kind == "card" and luhn("".join(filter(str.isdigit, value)))
        space = _space(kind, form)
        if (space, check) not in lists:
            rng = random.Random(key)
            every = map("".join, itertools.product(*(rng.sample(c, len(c)) for c in space)))
            lists[space, check] = filter(lambda x: luhn("".join(filter(str.isdigit, x))), every) if check else every
        new = next((x for x in lists[space, check] if x not in used), None)
        out.append(new)
        used.add(new or "")
    return out


def _mentions(text: str, names: set[str], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the whole-word mentions of names outside the spans, as they are or in upper case; longer names first."""
    spans = sorted(spans)
    for name in sorted(names, key=lambda x: (-len(x), x)):
        for form in dict.fromkeys((name, name.upper())):
            low = text.find(form)
            while low >= 0:
                high = low + len(form)
                i = bisect.bisect(spans, (low, high))
                free = (i == 0 or spans[i - 1][1] <= low) and (i == len(spans) or spans[i][0] >= high)
                if free and not (low and (text[low - 1].isalnum() or text[low - 1] == "_")) and not (high < len(text) and (text[high].isalnum() or text[high] == "_")):
                    spans.insert(i, (low, high))
                    yield low, high, name
                low = text.find(form, high)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities in a text, in order; a name gives one for each of its words after the title, and for each later or earlier mention."""
    found = []
    names: dict[str, set[str]] = {}
    for m in _RULES.finditer(text):
        kind, value = m.lastgroup, m.group()
        if m["given"] or m["quoted"]:
            at = "given" if m["given"] else "quoted"
            found.append((*m.span(at), "secret", m[at]))
            continue
        if kind != "name":
            found.append((m.start(), m.end(), kind, value.lower() if kind == "email" and value != value.lower() else value))
            continue
        title = re.match(r"\S+", value).group().rstrip(".")
        at = m.start()
        for w in re.finditer(_WORD, value[len(title) :]):
            low = at + len(title) + w.start()
            found.append((low, low + len(w.group()), "name", _normal(w.group())))
            names.setdefault(_normal(w.group()), set()).add(_TITLES[title])
    if not names:
        return found
    found += [(low, high, "name", name) for low, high, name in _mentions(text, set(names), [f[:2] for f in found])]
    kinds = {w: "name:" + ("" if {"m", "f"} <= g else max(g)) for w, g in names.items()}
    return sorted((low, high, kinds[value] if kind == "name" else kind, value) for low, high, kind, value in found)


def _key(kind: str, value: str) -> str:
    return f"{kind}\t{value}"


def replace(text: str, again: dict[str, str], key: bytes = KEY) -> str:
    """The text with surrogates; again: those of entities, by kind, tab and normal form, that don't have their first."""
    out, at = [], 0
    for low, high, kind, value in find(text):
        new = again.get(_key(kind, value)) or surrogate(kind, value, 0, key)
        out += [text[at:low], new.upper() if text[low:high].isupper() and kind.startswith(("email", "name")) else new]
        at = high
    return "".join([*out, text[at:]])


def _hits(column: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _HINT), False)).to_pylist()


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value) of each mention; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, texts = batch.column(0), batch.column(1)
            rows = [(ids[i].as_py(), kind, value) for i in _hits(texts) for _, _, kind, value in find(texts[i].as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "kind", "value"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, kind string, value string")


def _surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    """rows (kind, value, attempt) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values, attempts = (c.to_pylist() for c in b.columns[:3])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(k, v, a, key) for k, v, a in zip(kinds, values, attempts, strict=True)], pa.string())], ["kind", "value", "attempt", "surrogate"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def _exact(left: DataFrame, now: DataFrame, taken: DataFrame, key: bytes) -> DataFrame:
    """now and left (kind, value), these with surrogates that neither now nor taken has; attempt is -1. Forms of one length meet on one task."""
    schema = "kind string, value string, form string, surrogate string"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(["kind", "value"])
        rows = list(zip(a["kind"], a["value"], a["form"], strict=True))
        new = _free(rows, set(b["surrogate"]), key)
        forms = [f if x else _longer(k, f) for (k, _, f), x in zip(rows, new, strict=True)]
        return pd.DataFrame({"kind": a["kind"], "value": a["value"], "form": forms, "surrogate": pd.Series(new, a.index, object)})

    left = left.select("kind", "value", F.col("value").alias("form"))
    while not left.isEmpty():
        left = left.withColumn("n", F.length("form"))
        used = now.select("surrogate").unionByName(taken.select("surrogate")).withColumn("n", F.length("surrogate")).join(left.select("n").distinct(), "n", "left_semi")
        placed = settle(left.groupBy("n").cogroup(used.groupBy("n")).applyInPandas(run, schema))
        now = settle(now.unionByName(placed.filter("surrogate is not null").select("kind", "value", F.lit(-1).alias("attempt"), "surrogate")))
        left = placed.filter("surrogate is null").drop("surrogate")
    return now


def attempts(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, attempt, surrogate) of the entities whose first surrogate is another's, or is itself an entity of the corpus, or has another gender than their names elsewhere.

    Of entities with one surrogate that of least kind and value keeps it. Attempts go on until all differ; as a short
    format may have fewer surrogates than the corpus has entities, those left after ATTEMPTS get unused ones, of attempt -1.
    """
    seen = settle(entities(docs).select("kind", "value").distinct())
    name = F.col("kind").startswith("name:")
    genders = F.array_remove(F.collect_set(F.substring("kind", 6, 1)), "")
    named = seen.filter(name).groupBy("value").agg(F.concat(F.lit("name:"), F.when(F.size(genders) == 1, genders[0]).otherwise("")).alias("kind"))
    every = settle(seen.filter(~name).unionByName(named))
    now = settle(_surrogates(every.withColumn("attempt", F.lit(0)), key))
    taken = every.select(F.col("value").alias("surrogate")).distinct()
    for i in range(ATTEMPTS + 1):
        rank = Window.partitionBy("surrogate").orderBy("attempt", "kind", "value")
        bad = now.withColumn("rank", F.row_number().over(rank)).join(taken.withColumn("real", F.lit(True)), "surrogate", "left")
        bad = settle(bad.filter("rank > 1 or real").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        if bad.isEmpty():
            break
        rest = now.join(bad, ["kind", "value"], "left_anti")
        now = settle(rest.unionByName(_surrogates(bad, key))) if i < ATTEMPTS else _exact(bad, settle(rest), taken, key)
    changed = now.filter("attempt <> 0 and not startswith(kind, 'name:')")
    of = now.filter(name).select(F.col("kind").alias("one"), "value", "attempt", "surrogate")
    return changed.unionByName(seen.join(of, "value").filter(name & F.expr("attempt <> 0 or kind <> one")).drop("one"))


def replaced(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with surrogates in text; its other columns, and texts without entities, stay as they are.

    A null text stays null, an empty one empty. Rows that repeat an id are replaced one by one. Surrogates are as long as what they
    replace while their format has unused ones, so lengths of texts stay. Other columns pass, whatever their names.
    """
    again = settle(attempts(docs, key))
    few = again.limit(SHIPPED + 1).toArrow()
    at = docs.columns.index("text")
    if few.num_rows <= SHIPPED:
        shipped = {_key(k, v): new for k, v, new in zip(*(few[c].to_pylist() for c in ("kind", "value", "surrogate")), strict=True)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                texts = batch.column(at)
                new = {i: replace(texts[i].as_py(), shipped, key) for i in _hits(texts)}
                if new:
                    mask = [i in new for i in range(len(texts))]
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], schema=batch.schema)

        return docs.mapInArrow(run, docs.schema)
    # too many to ship: each text gets its own, by a hash of the text
    of = F.xxhash64(F.col("text").cast("string"))
    own = entities(docs.select(of.alias("doc_id"), "text")).distinct().join(again, ["kind", "value"])
    own = own.groupBy(F.col("doc_id").alias("pii_text")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\t", "kind", "value"), "surrogate"))).alias("pii_again"))

    @F.pandas_udf("string")
    def change(texts, agains):
        return texts.combine(agains, lambda x, y: x if x is None else replace(x, dict(y or {}), key))

    rows = docs.select(F.struct("*").alias("row"), of.alias("pii_text")).join(own, "pii_text", "left")
    return rows.select(*(change(F.col("row.text"), "pii_again").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents."""
    return replaced(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
