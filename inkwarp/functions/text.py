"""Scalar functions on text columns: dates, names, countries, numbers, lists, tags."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SENTINEL = "9999/01/01"
STATES = frozenset("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC AS GU MP PR VI FM MH PW".split())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f or functions inside it name it."""
    return F.transform(F.array(value), f)[0]


def month(name: Column) -> Column:
    """Two digits of a month's name, by its first three letters; else null (TX-02)."""
    key = F.lower(F.substring(name, 1, 3))
    return F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}"))), key)


def slash_date(year: Column, month_: Column | None = None, day: Column | None = None) -> Column:
    """YYYY/MM/DD from parts; missing month and day are 01, a missing year gives the sentinel (TX-01)."""
    part = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("01")) if c is not None else F.lit("01")
    has_month = month_.isNotNull() if month_ is not None else F.lit(False)
    return F.when(year.isNull() | (year.cast("string") == ""), F.lit(SENTINEL)).otherwise(F.concat_ws("/", year.cast("string"), part(month_), F.when(has_month, part(day)).otherwise("01")))


def long_date(text: Column) -> Column:
    """"Month D, YYYY" as YYYY/MM/D; other text stays (TX-03, TX-04)."""
    p = r"(\w+) (\d+), (\d+)"
    m = month(F.regexp_extract(text, p, 1))
    return F.when(m.isNotNull(), F.concat_ws("/", F.regexp_extract(text, p, 3), m, F.regexp_extract(text, p, 2))).otherwise(text)


def slashes(text: Column) -> Column:
    """Hyphens of a date as slashes (TX-05)."""
    return F.translate(text, "-", "/")


def year(text: Column) -> Column:
    """The year that begins a date, else the text (TX-06)."""
    return F.regexp_replace(text, r"^(\d{4}).+$", "$1")


def country(address: Column) -> Column:
    """The last word of an address in capitals; one with a digit is a US postal code (TX-21)."""
    words = F.filter(F.split(F.translate(address, '"', ""), "[ ,]+"), lambda w: w != "")
    last = F.upper(F.try_element_at(words, F.lit(-1)))
    return F.when(last.rlike("[0-9]"), F.lit("USA")).otherwise(last)


def without_copyright(text: Column) -> Column:
    """Publishers' copyright lines removed (TX-22)."""
    return F.trim(F.regexp_replace(text, r"(?i)\(c\) *[0-9]+ +elsevier +ltd\. +all +rights +reserved\.", ""))


def number(text: Column) -> Column:
    """1.124 is 1124 (dots group), 0,46 is 0.46 (TX-32)."""
    return F.regexp_replace(F.regexp_replace(text, r"([0-9]+)\.([0-9]+)", "$1$2"), r"([0-9]+),([0-9]+)", "$1.$2").cast("double")


def plain(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed (TX-31)."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def lines(text: Column, separator: str = "; ") -> Column:
    """A list as lines, all but the first indented by three blanks (TX-29)."""
    return F.array_join(F.split(text, re.escape(separator)), "\n   ")


def address(institution: Column) -> Column:
    """"Last, First, a, b, c, ..., z" as "[Last, First] b, a, c, z."; parts that aren't there are empty (TX-28)."""
    p = F.split(institution, ", ")
    at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    return F.concat(F.lit("["), at(0), F.lit(", "), at(1), F.lit("] "), F.array_join(F.array(at(3), at(2), at(4), F.element_at(p, -1)), ", "), F.lit("."))


def occurrences(text: Column, word: Column) -> Column:
    """How often a word's letters occur in a text, whatever the case (TX-23)."""
    n = F.length(word)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(F.lower(text), F.lower(word), F.lit("")))) / n).cast("int")).otherwise(0)


def bucket(number_: Column) -> Column:
    """The folder of a patent number: its last two characters (TX-33)."""
    return F.right(number_, F.lit(2))


def rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Screen colours from those of print, shares of 0 to 1 (TX-36)."""
    black = k * 255
    one = lambda v: (255 - F.floor(F.least(F.lit(255.0), v * (255 - black) + black) + 0.5)).cast("int")
    return F.struct(one(c).alias("r"), one(m).alias("g"), one(y).alias("b"))


def decoded(form: Column) -> Column:
    """name=value&... as a map; a repeated name has its values joined by NUL (TX-35)."""
    plain = lambda x: F.try_url_decode(x)
    pairs = F.transform(F.filter(F.split(form, "&"), lambda x: x != ""), lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), F.when(x.contains("="), plain(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")))
    return let(pairs, lambda x: let(F.array_distinct(F.transform(x, lambda p: p["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(x, lambda p: p["k"] == n), lambda p: p["v"]), "\0")))))


def owners(text: Column, raw: Column | None = None) -> Column:
    """Owners "Name (City, CC), ..." as structs name, city, state, country, kind: 2 a company, 1 a person (TX-13).

    A code of a US state is the state, unless the raw page has it in bold, which is how it marks countries.
    """
    parts = F.split(text, r"\)[,\s]*")
    whole, short = r";?\s?(.+) \((.+), (.+)$", r";?\s?(.+) \((.+)$"

    def one(x: Column) -> Column:
        long = x.rlike(whole)
        code = F.when(long, F.regexp_extract(x, whole, 3)).otherwise(F.regexp_extract(x, short, 2))
        bold = F.coalesce(F.lower(raw).contains(F.concat(F.lit("<b>"), F.lower(code))), F.lit(False)) if raw is not None else F.lit(False)
        state = code.isin(*sorted(STATES)) & ~bold
        name = F.when(long, F.regexp_extract(x, whole, 1)).otherwise(F.regexp_extract(x, short, 1))
        name = F.trim(F.concat(F.substring_index(name, ";", 1), F.when(name.contains(";"), F.lit(",")).otherwise(""), F.regexp_replace(name, "^[^;]*;?", "")))
        kind = F.when(name.rlike(r"Ltd|Inc\.|Corporation|Corp\W*$"), 2).otherwise(1)
        return F.struct(name.alias("name"), F.when(long, F.regexp_extract(x, whole, 2)).alias("city"), F.when(state, code).alias("state"), F.when(state, "US").otherwise(code).alias("country"), kind.alias("kind"))

    return F.transform(F.filter(parts, lambda x: x.rlike(short)), one)


def fixed(x: Column, digits: int = 4) -> Column:
    """A number with so many digits after the point, as text (TX-39)."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def doubled(text: Column) -> Column:
    """Quotes doubled, for SQL that takes no parameters (TX-34)."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def today() -> Column:
    """Year/month/day without zeros (TX-40)."""
    return F.date_format(F.current_date(), "yyyy/M/d")


def capitalised(text: Column) -> Column:
    """The first letter of each word in capitals (TX-42)."""
    return F.initcap(text)


def unix_lines(text: Column) -> Column:
    """Line ends of other systems as line feeds (SK-18)."""
    return F.regexp_replace(text, "\r\n?", "\n")


def title_and_abstract(text: Column) -> Column:
    """The first of the blocks that five line breaks part, with the second where it begins with Abstract (PF-10)."""
    parts = F.split(text, "\n{5}")
    return F.concat(parts[0], F.when(F.size(parts) > 1, F.lit("\n" * 5)).otherwise(""), F.when(F.get(parts, F.lit(1)).rlike(r"^\s*Abstract"), F.concat(F.get(parts, F.lit(1)), F.when(F.size(parts) > 2, F.lit("\n" * 5)).otherwise(""))).otherwise(""))


# stems

def _measure(word: str) -> int:
    """Changes from vowel to consonant."""
    shape = re.sub(r"[^aeiouy]+", "c", re.sub(r"(?<=[aeiou])y|^y", "c", word))
    return len(re.findall(r"[aeiouy]+c", shape))


def _singular(w: str, deep: bool) -> str:
    if w.endswith("ies"):
        return w[:-3] + ("i" if deep else "y")
    if w.endswith("s") and not (deep and re.search("[aeious]s$", w)):
        return w[:-1]
    return w


def _inflected(w: str, deep: bool) -> str:
    for end, new in (("ied", "i" if deep else "y"), ("eed", "e" if deep else "ee"), ("ed", ""), ("ing", "")):
        base = w[: -len(end)]
        if w.endswith(end) and re.search("[aeiouy]", base):
            base += new
            return base[:-1] if not new and len(base) > 2 and base[-1] == base[-2] and base[-1] not in "lsz" else base
    return w


_SECOND = (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("icate", "ic"), ("ative", ""), ("ness", ""), ("ful", ""))
_LAST = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "ous", "ive", "ize", "al", "er", "ic")


def stem(word: str, deep: bool = False) -> str:
    """Stem of a lower-case word; those of three letters or less, or with other signs than a-z, stay (TX-07).

    Light: a plural ending, then a past or progressive one; where the second doesn't apply the first is tried again. Deep
    also takes derivational endings off stems that are long enough.
    """
    if not re.fullmatch(r"[a-z]{4,}", word):
        return word
    w = _singular(word, deep)
    after = _inflected(w, deep)
    if not deep:
        return after if after != w else _singular(w, deep)
    w = after
    for end, new in _SECOND:
        if w.endswith(end) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + new
            break
    for end in _LAST:
        if w.endswith(end) and _measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
            break
    return w[:-1] if w.endswith("e") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """stem of each word in lower case; each different word once."""
    known = {w: stem(w.lower()) for w in words.dropna().unique()}
    return pd.Series([known.get(w) for w in words], dtype=object)


# journal names

_SMALL = frozenset("of the and for in on de la a an und der fur et".split())


def journal_match(short: str | None, full: str | None) -> bool:
    """Whether an abbreviated journal name can stand for a full one: each of its words begins the next full word that it can, in order (TX-27)."""
    if not short or not full:
        return False
    tokens = lambda x: [w for w in re.sub(r"-", " - ", x).lower().split() if w not in _SMALL and w != "-"]
    a, b = tokens(short), tokens(full)
    if not a or not b:
        return False
    at = 0
    for i, w in enumerate(a):
        bare = re.sub(r"\W+$", "", w)
        while at < len(b) and not (b[at].startswith(w) or bare and b[at].startswith(bare)):
            if i == 0:
                return False
            at += 1
        if at == len(b):
            return i > 0 and len(w) <= 1
        at += 1
    return True


def journal_key(name: Column) -> Column:
    """The first word that counts of a journal's name, in lower case, its end without signs: where an abbreviation's begins the full name's, they may match (TX-27)."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, "-", " - ")), r"\s+"), lambda w: (w != "") & (w != "-") & ~w.isin(*sorted(_SMALL)))
    return F.regexp_replace(F.get(words, F.lit(0)), r"\W+$", "")


@F.pandas_udf(BooleanType())
def journals_match(short: pd.Series, full: pd.Series) -> pd.Series:
    return pd.Series([journal_match(a, b) for a, b in zip(short, full, strict=True)], dtype=bool)
