"""Patents: pages of two layouts, sections of descriptions, claims, owners' and citations' lists.

Pages are parsed in Arrow batches by the standard HTML parser; all that follows is arrays of paragraphs in column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkwarp.functions.text import let, month, slash_date

BREAK = "<BR><BR>"
#: The fields of a page. Lists of a kind are one text, as the page has them.
FIELDS = ("pat_no", "issued", "title", "inventors", "inventors_raw", "assignee", "assignee_raw", "family_id", "apply_no", "filed", "us_class", "cpc_class", "intern_class", "search_field", "abstract", "claims", "description", "application", "task", "summary", "features", "drawings", "parent_case")
PAGE = StructType([*(StructField(f, StringType()) for f in FIELDS), StructField("cites", ArrayType(StringType()))])
_MONTHS = {m: f"{i:02d}" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, **dict.fromkeys("div h1 h2 h3 h4 h5 h6 table ul ol dl pre form section article hr blockquote".split(), {"p"}), "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_KEEPS = frozenset("table div body html section article ul ol dl".split())


class Node:
    """An element: its children are texts and elements."""

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        #: Of a page's root: the elements of each tag in the order of the page, and the first of a tag by its text.
        self.of: dict[str, list[Node]] | None = None
        self.first: dict[str, dict[str, Node]] = {}

    def text(self) -> str:
        return "" if self.tag in ("script", "style") else "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def down(self, tag: str, ok: Callable[[Node], bool] = lambda n: True) -> Node | None:
        """The first element of this tag, itself or below, that is ok."""
        if self.of is not None:
            return next((n for n in self.of.get(tag, ()) if ok(n)), None)
        waiting: list[Node] = [self]
        while waiting:
            n = waiting.pop()
            if n.tag == tag and ok(n):
                return n
            waiting += [c for c in reversed(n.children) if not isinstance(c, str)]
        return None

    def saying(self, tag: str, text: str) -> Node | None:
        """The first element of this tag in a page whose text, stripped, is this one; each text is made once."""
        if tag not in self.first:
            self.first[tag] = {}
            for n in (self.of or {}).get(tag, ()):
                self.first[tag].setdefault(n.text().strip(), n)
        return self.first[tag].get(text)

    def after(self) -> list[str | Node]:
        """What follows it in its parent."""
        if self.parent is None:
            return []
        return self.parent.children[next(i for i, c in enumerate(self.parent.children) if c is self) + 1 :]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.root.of = {"html": [self.root]}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        close = _CLOSES.get(tag, set())
        n = self.at
        while n is not None and close:
            if n.tag in close:
                self.at = n.parent or self.root
            elif n.tag in _KEEPS:
                break
            n = n.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        self.root.of.setdefault(tag, []).append(node)  # elements open in the order of the page
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def day_of(text: str) -> str:
    """"Month D, YYYY" in a text as YYYY/MM/D, full names of months only; other text stays (TX-03)."""
    m = re.search(r"(\w+)\s+(\d{1,2}),\s+(\d{4})", text)
    return f"{m[3]}/{_MONTHS.get(m[1], '')}/{m[2]}" if m else text


def _labelled(root: Node, tag: str, label: str) -> str:
    """The text of the first element with any after the one that is the label."""
    n = root.saying(tag, label)
    return next((t for c in (n.after() if n else ()) if not isinstance(c, str) and (t := c.text()).strip()), "")


def _under(root: Node, heading: str) -> str:
    n = root.down("h3", lambda x: x.text().strip().lower() == heading.lower())
    right = n.after() if n else []
    return "" if not right else right[0] if isinstance(right[0], str) else right[0].text()


def _between(root: Node, heading: str, start: str, stops: tuple[str, ...]) -> str:
    """Texts of a paragraph under a heading, from the one with the start label to one with a stop label (TX-20)."""
    n = root.down("h3", lambda x: bool(re.search(rf"\b{heading}\b", x.text(), re.I)))
    found = next((p for c in (n.after() if n else ()) if not isinstance(c, str) and (p := c.down("p", lambda x: bool(re.search(rf"\b(?:{start})\b", x.text(), re.I))))), None)
    out, on = "", False
    for t in found.children if found else ():
        if not isinstance(t, str):
            continue
        on = on or bool(re.search(rf"\b(?:{start})\b", t))
        if on:
            if any(re.search(rf"\b{s}\b", t, re.I) for s in stops):
                return out
            out += t + " " if t.strip() else ""
    return out


def new_page(html: str) -> dict:
    """The fields of a page of the newer layout: by class, by label followed by its value, by heading (TX-18)."""
    r = tree(html)
    number = r.down("span", lambda n: n.attrs.get("class") == "MatchFromOtherFieldStyle")
    title = r.down("h2")
    p = {"pat_no": number.text() if number else "", "issued": day_of(_labelled(r, "span", "Date of Patent")), "title": title.text() if title else "", "filed": day_of(_labelled(r, "p", "Filed:")), "abstract": _under(r, "Abstract"), "claims": _under(r, "Claims"), "cites": []}
    for field, label in (("inventors", "Inventors:"), ("assignee", "Assignee:"), ("family_id", "Family ID:"), ("apply_no", "Appl. No.:"), ("us_class", "U.S. Cl.:"), ("cpc_class", "CPC"), ("intern_class", "Int. Cl.:")):
        p[field] = _labelled(r, "p", label)
    p["application"] = _between(r, "Background/Summary", r"FIELD[\W ]*", (r"BACKGROUND[\W ]*",))
    p["task"] = _between(r, "Background/Summary", r"BACKGROUND[\W ]*", (r"SUMMARY[\W ]",))
    p["summary"] = _between(r, "Background/Summary", r"SUMMARY[\W ]", ())
    p["features"] = _between(r, "Description", "DESCRIPTION OF EXAMPLE EMBODIMENTS|DESCRIPTION OF THE PREFERRED EMBODIMENTS", ("BRIEF DESCRIPTION OF THE DRAWINGS",))
    p["drawings"] = _between(r, "Description", "BRIEF DESCRIPTION OF THE DRAWINGS", ("DETAILED DESCRIPTION", "DESCRIPTION OF EXAMPLE EMBODIMENTS"))
    return p


def _bare(html: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html)).strip()


_KEYS = {"Inventors": "inventors", "Assignee": "assignee", "Family ID": "family_id", "Appl. No.": "apply_no", "Filed": "filed", "Current U.S. Class": "us_class", "Current CPC Class": "cpc_class", "Intern Class": "intern_class", "Field of Search": "search_field"}


def _attributes(block: str, p: dict) -> None:
    for row in re.split(r"(?i)<TR>", block):
        parts = re.split(r"(?i)</TH>", row, maxsplit=1)
        if len(parts) < 2 or not parts[1]:
            parts = re.split(r"(?i)</TD>", row, maxsplit=1)
        key = _bare(parts[0]).removesuffix(":").replace("'l", "")
        value = re.split(r"(?i)</T[HD]>", parts[1])[0] if len(parts) > 1 else ""
        key = "Intern Class" if "Intern" in key else "Assignee" if "Assignee" in key else "Current U.S. Class" if re.search(r"U\.S\..*Class", key) else key
        if key in _KEYS:
            p[_KEYS[key]] = _bare(value)
            if key in ("Inventors", "Assignee"):
                p[_KEYS[key] + "_raw"] = value


def old_page(html: str) -> dict:
    """The fields of a page of the older layout: blocks between rules, each known by its place or its headings (TX-19)."""
    blocks, p = re.split(r"<[Hh][Rr]>", html), {"cites": []}
    i = 0
    while i < len(blocks):
        b = blocks[i]
        if i == 0:
            if m := re.search(r"United States Patent(\s\w+)?: ([,\d]+)", b):
                p["pat_no"] = m[2].replace(",", "")
        elif i == 1:
            if m := re.search(r"(\w+) (\d+), (\d+)", b):
                p["issued"] = f"{m[3]}/{next((v for k, v in _MONTHS.items() if k[:3] == m[1][:3]), '01')}/{m[2]}"
            if m := re.search(r">\s*([,\d]+)\s*</", b):
                p["pat_no"] = m[1].replace(",", "")
        elif i == 2:
            title, *rest = re.split(r"(?i)</font><BR>", b)
            p["title"] = _bare(title)
            p["abstract"] = re.sub(r"(?i)^\s*Abstract\s*", "", re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", rest[0]))) if rest else ""
        elif re.search(r"(?i)>Inventors:\s*<|>Assignee:\s*<| Class:\s*<|Field of Search:", b):
            _attributes(b, p)
            if i == 3 and i + 1 < len(blocks) and not all(p.get(x) for x in ("us_class", "intern_class", "search_field")):
                i += 1  # newer pages have the classes in a block of their own
                _attributes(blocks[i], p)
        elif "Other References" in b:
            pass
        elif "References Cited" in b:
            i += 1
            for t in re.split(r"(?i)</TABLE>", blocks[i] if i < len(blocks) else ""):
                for row in re.split(r"(?i)<br>" if "Other References" in t else r"(?i)<TR>", t):
                    cells = [_bare(x) for x in re.split(r"(?i)</TD>", row)]
                    cite = re.sub(r"\t+", "\t", "\t".join(cells)).strip("\t")
                    p["cites"] += [cite] * bool(cite)
        elif "Foreign Patent Documents" in b:
            pass
        else:
            for name, field in (("Parent Case", "parent_case"), ("Claims", "claims"), ("Description", "description")):
                if name in b:
                    i += 1
                    text = blocks[i] if i < len(blocks) else ""
                    p[field] = text if field == "description" else re.sub(r"\s+", " ", text)
                    break
        i += 1
    return p


def _frame(pages: pd.Series, parse: Callable[[str], dict]) -> pd.DataFrame:
    rows = [parse(h) if isinstance(h, str) else {} for h in pages]
    return pd.DataFrame({f: pd.Series([r.get(f) or None for r in rows], dtype=object) for f in FIELDS} | {"cites": [r.get("cites", []) for r in rows]})


@F.pandas_udf(PAGE)
def new_pages(html: pd.Series) -> pd.DataFrame:
    """new_page of each page; a field without text is null."""
    return _frame(html, new_page)


@F.pandas_udf(PAGE)
def old_pages(html: pd.Series) -> pd.DataFrame:
    """old_page of each page; a field without text is null."""
    return _frame(html, old_page)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, parted by two line breaks of HTML."""
    return F.split(text, "(?i)<BR><BR>")


def _blank(p: Column) -> Column:
    return p.rlike(r"^\s*$")


def sections(paras: Column, stop: Callable[[Column], Column], head: Callable[[Column], Column], keep_blank: bool = False) -> Column:
    """array<struct<title, body array>>: a section opens at each paragraph that is a stop and a head and goes to the next stop.

    White space in bodies is collapsed and blank paragraphs are dropped.
    """

    def one(ps: Column, ends: Column, i: Column) -> Column:
        body = let(F.array_min(F.filter(ends, lambda j: j > i)), lambda end: F.transform(F.slice(ps, i + 2, end - i - 1), lambda p: F.regexp_replace(p, r"\s+", " ")))
        return F.struct(F.regexp_replace(F.get(ps, i), r"^\s+|\s+$", "").alias("title"), (body if keep_blank else F.filter(body, lambda p: ~_blank(p))).alias("body"))

    def found(ps: Column) -> Column:
        return let(F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: stop(F.get(ps, i))), lambda at: let(F.concat(at, F.array(F.size(ps))), lambda ends: F.transform(F.filter(at, lambda i: head(F.get(ps, i))), lambda i: one(ps, ends, i))))

    return F.when(F.size(paras) > 0, let(paras, found))


def contents(description: Column) -> Column:
    """Sections under headings in capitals of nine words or less (TX-10)."""
    capitals = lambda p: p.rlike(r"^[A-Z()\s]+$")
    return sections(paragraphs(description), capitals, lambda p: ~_blank(p) & (F.length(F.regexp_replace(p, "[^ ]", "")) < 9))


def is_headline(line: Column) -> Column:
    """80 characters or less with a word of headings, in capitals or capitalised (TX-11)."""
    return (F.length(line) <= 80) & line.rlike("FIELD|BACKGROUND|SUMMARY|DRAWINGS|DESCRIPTION|EMBODIMENT|Field|Art|Background|Summary|Description|Embodiment")


NAMES = ("application", "task", "summary", "drawings", "features")


def tagged_sections(description: Column) -> Column:
    """array<struct<name, title, body>>: headline sections that aren't empty, by what their title says (TX-12).

    FIELD is the application, BACKGROUND or Art the task, the first SUMMARY the summary, the first DRAWINGS the drawings, DESCRIPTION or
    EMBODIMENT the features; others have no name. Of two of a name the later holds.
    """
    found = F.filter(sections(paragraphs(description), is_headline, is_headline), lambda s: F.size(s["body"]) > 0)
    says = lambda s, words: s["title"].rlike(f"(?i){words}")
    early = lambda s: says(s, "FIELD|BACKGROUND|Art")
    numbered = F.transform(found, lambda s, i: F.struct(i.alias("i"), s["title"].alias("title"), s["body"].alias("body")))
    place = lambda rows, ok: F.array_min(F.transform(F.filter(rows, ok), lambda s: s["i"]))

    def name(s: Column, first: Column, drawn: Column) -> Column:
        return F.when(says(s, "FIELD"), "application").when(says(s, "BACKGROUND|Art"), "task").when(F.equal_null(s["i"], first), "summary").when(F.equal_null(s["i"], drawn), "drawings").when(says(s, "DESCRIPTION|EMBODIMENT"), "features")

    def one(s: Column, n: Column) -> Column:
        stars = F.element_at(s["body"], -1).contains("* * * * *") & F.equal_null(n, F.lit("features"))
        return F.struct(n.alias("name"), s["title"].alias("title"), F.when(stars, F.slice(s["body"], F.lit(1), F.size(s["body"]) - 1)).otherwise(s["body"]).alias("body"))

    def drawn(rows: Column, first: Column) -> Column:
        return place(rows, lambda s: ~early(s) & says(s, "DRAWINGS") & ~F.equal_null(s["i"], first))

    return let(numbered, lambda rows: let(place(rows, lambda s: ~early(s) & says(s, "SUMMARY")), lambda first: let(drawn(rows, first), lambda d: F.transform(rows, lambda s: let(name(s, first, d), lambda n: one(s, n))))))


def section_of(tagged: Column, name: str) -> Column:
    """The last section of a name, null where there is none."""
    return F.try_element_at(F.filter(tagged, lambda s: F.equal_null(s["name"], F.lit(name))), F.lit(-1))


_NUMBERED = r"^(\[\d+\]\s*)?\d\.\s*[\w\s]+$"


def background(task: Column) -> Column:
    """struct<application, task> (arrays): a task's numbered subsections on the field and the art; without one on the field, the first paragraph is the application (TX-16)."""
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    found = sections(task, lambda p: p.rlike(_NUMBERED), lambda p: (words(p) <= 8) & (F.trim(F.regexp_replace(p, r"^(\[\d+\]\s*)?\d\.\s*", "")) != ""), keep_blank=True)
    field = lambda x: F.try_element_at(F.filter(x, lambda s: s["title"].contains("Field")), F.lit(-1))["body"]
    art = lambda x: F.try_element_at(F.filter(x, lambda s: s["title"].contains("Art") & ~s["title"].contains("Field")), F.lit(-1))["body"]

    def one(f: Column, rest: Column) -> Column:
        none = f.isNull() | (F.array_join(f, "") == "")
        return F.struct(F.when(none, F.slice(rest, 1, 1)).otherwise(f).alias("application"), F.when(none, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest).alias("task"))

    return let(task, lambda t: let(found, lambda x: let(field(x), lambda f: let(F.coalesce(art(x), t), lambda rest: one(f, rest)))))


def claims(text: Column) -> Column:
    """array<struct<no, leading, text>>: claims begin with a number and a dot; one that names no other claim leads (TX-09, AG-13)."""
    items = F.filter(F.split(text, r"(?i)<BR><BR>(?=\d+\.)"), lambda x: x.rlike(r"^\d+\."))

    def one(x: Column) -> Column:
        paras = paragraphs(x)
        return F.struct(F.regexp_extract(x, r"^(\d+)\.", 1).cast("int").alias("no"), (~paras[0].rlike(r"(?i)claim \d+")).alias("leading"), F.array_join(F.filter(paras, lambda p: ~_blank(p)), BREAK).alias("text"))

    return F.transform(items, one)


def routed(cites: Column) -> Column:
    """struct<us, foreign, other>: citations under the headings of the three kinds, up to the examiner or attorney (TX-14)."""
    off = r"(?i)^\s*(Primary\s+Examiner:|Attorney)"
    heads = {"us": r"(?i)^\s*U.S.\s+Patent", "foreign": r"(?i)^\s*Foreign\s+Patent", "other": r"(?i)^\s*Other\s+Reference"}
    stop = lambda p: p.rlike(off) | p.rlike(heads["us"]) | p.rlike(heads["foreign"]) | p.rlike(heads["other"])

    def of(cs: Column, at: Column, ends: Column, pattern: str) -> Column:
        lists = F.transform(F.filter(at, lambda i: F.get(cs, i).rlike(pattern)), lambda i: F.slice(cs, i + 2, F.array_min(F.filter(ends, lambda j: j > i)) - i - 1))
        return F.filter(F.flatten(lists), lambda c: ~_blank(c))

    places = lambda cs: F.when(F.size(cs) > 0, F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: stop(F.get(cs, i)))).otherwise(F.array().cast("array<int>"))
    return let(F.coalesce(cites, F.array().cast("array<string>")), lambda cs: let(places(cs), lambda at: let(F.concat(at, F.array(F.size(cs))), lambda ends: F.struct(*(of(cs, at, ends, p).alias(k) for k, p in heads.items())))))


def paper_reference(text: Column) -> Column:
    """struct<type, year, vol, page, author, title, journal> of a free citation, null where it doesn't say; type 1 has all of volume, page and year, 2 a year, 0 none (TX-17).

    The rules are our own: the title is between quotation marks, the author before it or before the first comma, the journal
    between title and volume.
    """
    some = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    year, vol, page = some(r"\b(1[89]\d\d|20\d\d)\b"), some(r"(?i)\bvol\.?\s*(\d+)"), some(r"(?i)\bpp?\.?\s*(\d+)")
    title = some(r'["“]([^"”]+?)[,.]?["”]')
    author = F.when(title.isNotNull(), some(r'^\s*([^"“]*?)[,;:.]?\s*["“]')).otherwise(some(r"^\s*([^,]+),"))
    journal = F.when(title.isNotNull(), some(r'["”][,.]?\s*([^"“”]*?),?\s*(?i:\bvol\b|\bpp?\.|\b(?:1[89]|20)\d\d\b|$)'))
    kind = F.when(year.isNotNull() & vol.isNotNull() & page.isNotNull(), 1).when(year.isNotNull(), 2).otherwise(0)
    return F.struct(kind.alias("type"), slash_date(year).alias("year"), vol.alias("vol"), page.alias("page"), author.alias("author"), title.alias("title"), journal.alias("journal"))


def cited_patent(row: Column) -> Column:
    """struct<no, date, owner, class> of a tab-separated citation; a date of another form stays (TX-15)."""
    p = F.split(row, "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    when = r"(\w+).+(\d\d\d\d)"
    date = F.when(at(2).rlike(when), slash_date(F.regexp_extract(at(2), when, 2), month(F.regexp_extract(at(2), when, 1)))).otherwise(at(2))
    return F.struct(at(1).alias("no"), date.alias("date"), F.regexp_replace(at(3), r"\s*et\s+al|\.\s*$", "").alias("owner"), F.regexp_replace(at(4), r"\.\s*$", "").alias("class"))


def cited(kind: str, c: Column) -> Column:
    """A citation as text: owner or country, year, number; for papers author, year, journal, volume, page (TX-44)."""
    year = F.regexp_replace(c["year"] if kind == "other" else c["date"], r"^(\d{4}).+", "$1")
    parts = [c["author"], year, c["journal"], c["vol"], c["page"]] if kind == "other" else [c["owner"], year, c["no"]]
    return F.array_join(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), ", ")
