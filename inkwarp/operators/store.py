"""The relational store of patents: seven tables by patent number, and two dimensions that grow by names they lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.functions import text as T
from inkwarp.operators.counting import renumbered
from inkwarp.session import deleted, settle, written

#: Description fields in their sequence, and fields of classes.
DESCRIPTIONS = ("application", "task", "abstract", "summary", "features", "topics", "claims", "drawings")
CLASSES = {"us_class": "Current U.S. Class", "cpc_class": "Current CPC Class", "intern_class": "Intern Class"}


def grown(known: DataFrame | None, names: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number): a dimension with names it lacked; known ones keep their numbers, new ones follow in order of name (JN-03, JN-04).

    Different names are few (countries, kinds of sections); those new are ranked on one task.
    """
    new = names.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    last = 0
    if known is not None:
        new = new.join(known.select(name), name, "left_anti")
        last = known.agg(F.max(number)).first()[0] or 0
    new = new.select(name, (F.row_number().over(Window.orderBy(name)) + last).cast("int").alias(number))
    return new if known is None else known.select(name, number).unionByName(new)


def infos(p: DataFrame) -> DataFrame:
    """(patent_no, country, issued, title, family_id, apply_no, apply_date, search_field); the date of application is that of its prose (SK-08, TX-04)."""
    return p.select(F.col("pat_no").alias("patent_no"), F.lit("US").alias("country"), F.to_date("issued", "yyyy/M/d").alias("issued"), "title", "family_id", "apply_no", F.to_date(T.long_date(F.col("filed")), "yyyy/M/d").alias("apply_date"), "search_field")


def class_items(p: DataFrame) -> DataFrame:
    """(patent_no, class_type, class, is_main): items of each class field, without notes after a hard blank; the first of a field is main (SK-10)."""

    def items(field: str, label: str) -> Column:
        parts = F.filter(F.transform(F.split(field, r"\s*;\s*"), lambda c: F.regexp_replace(c, "(?s)(&nbsp| ).*$", "")), lambda c: c != "")
        return F.transform(parts, lambda c, i: F.struct(F.lit(label).alias("class_type"), c.alias("class"), (i == 0).alias("is_main")))

    every = F.concat(*(F.coalesce(items(f, label), F.array()) for f, label in CLASSES.items()))
    return p.select(F.col("pat_no").alias("patent_no"), F.inline(every))


def owners(p: DataFrame) -> DataFrame:
    """(patent_no, owner_type, place, name, city, state, country, kind): inventors and assignees one by one (SK-11)."""
    one = lambda field, label: F.transform(T.owners(F.col(field), F.col(f"{field}_raw")), lambda o, i: F.struct(F.lit(label).alias("owner_type"), i.alias("place"), o["name"].alias("name"), o["city"].alias("city"), o["state"].alias("state"), o["country"].alias("country"), o["kind"].alias("kind")))
    return p.select(F.col("pat_no").alias("patent_no"), F.inline(F.concat(*(F.coalesce(one(f, label), F.array()) for f, label in (("inventors", "Inventors"), ("assignee", "Assignee"))))))


def cited_patents(p: DataFrame) -> DataFrame:
    """(patent_no, cited_no, date, inventor, class, country): those of the US have an inventor, foreign ones a country (SK-12)."""
    of = P.routed(F.col("cites"))
    row = lambda c, us: F.struct(c["no"].alias("cited_no"), c["date"].alias("date"), (c["owner"] if us else F.lit("")).alias("inventor"), c["class"].alias("class"), (F.lit("US") if us else c["owner"]).alias("country"))
    both = F.concat(F.transform(of["us"], lambda c: row(P.cited_patent(c), True)), F.transform(of["foreign"], lambda c: row(P.cited_patent(c), False)))
    return p.select(F.col("pat_no").alias("patent_no"), F.inline(both))


def cited_papers(p: DataFrame) -> DataFrame:
    """(id, patent_no, type, year, vol, page, author, title, journal, citation): other references with their text; the id is a hash (SK-13)."""
    rows = p.select(F.col("pat_no").alias("patent_no"), F.posexplode(P.routed(F.col("cites"))["other"]).alias("place", "citation"))
    return rows.select(F.xxhash64("patent_no", "place", "citation").alias("id"), "patent_no", P.paper_reference(F.col("citation")).alias("c"), "citation").select("id", "patent_no", "c.*", "citation")


def descriptions(p: DataFrame, summaries: DataFrame | None = None, everything: bool = True) -> DataFrame:
    """(patent_no, sequence, type, title, text, summary): a row for each field in DESCRIPTIONS, the abstract alone unless everything (SK-09).

    p has the fields as texts, and their titles as field_title where they have any. summaries: (patent_no, type, summary).
    """
    have = set(p.columns)
    null = F.lit(None).cast("string")
    one = lambda i, f: F.struct(F.lit(i).alias("sequence"), F.lit(f).alias("type"), F.coalesce(F.col(f"{f}_title") if f"{f}_title" in have else null, F.lit(f)).alias("title"), (F.col(f) if f in have else null).alias("text"))
    rows = p.select(F.col("pat_no").alias("patent_no"), F.inline(F.array(*(one(i, f) for i, f in enumerate(DESCRIPTIONS) if everything or f == "abstract"))))
    return rows.withColumn("summary", null) if summaries is None else rows.join(summaries, ["patent_no", "type"], "left")


def full_texts(p: DataFrame, source: str, url: str, html: str = "html") -> DataFrame:
    """(patent_no, source, url, updated, text): raw pages as they were fetched today (SK-07)."""
    return p.select(F.col("pat_no").alias("patent_no"), F.lit(source).alias("source"), F.replace(F.lit(url), F.lit("$patnum"), F.col("pat_no")).alias("url"), F.current_date().alias("updated"), F.col(html).alias("text"))


def with_sections(p: DataFrame) -> DataFrame:
    """Pages of the older layout with the texts and titles of their sections; without an application it comes from the task (TX-12, TX-16)."""
    p = p.withColumn("tagged", P.tagged_sections(F.col("description")))
    for f in P.NAMES:
        p = p.withColumn(f"{f}_section", P.section_of(F.col("tagged"), f))
    split = P.background(F.col("task_section.body"))
    none = F.col("application_section").isNull() & F.col("task_section").isNotNull()
    body = {f: F.col(f"{f}_section.body") for f in P.NAMES} | {"application": F.when(none, split["application"]).otherwise(F.col("application_section.body")), "task": F.when(none, split["task"]).otherwise(F.col("task_section.body"))}
    return p.withColumns({f: F.array_join(body[f], P.BREAK) for f in P.NAMES} | {f"{f}_title": F.col(f"{f}_section.title") for f in P.NAMES}).drop("tagged", *(f"{f}_section" for f in P.NAMES))


def tables(p: DataFrame, summaries: DataFrame | None = None, source: str = "pages", url: str = "") -> dict[str, DataFrame]:
    """The tables of parsed pages (columns of FIELDS and html), with names of countries and kinds; patents without number are left out (SK-06)."""
    p = p.filter("pat_no <> ''")
    return {"full_text": full_texts(p, source, url), "info": infos(p), "description": descriptions(p, summaries), "class": class_items(p), "owner": owners(p), "cite_patent": cited_patents(p), "cite_paper": cited_papers(p)}


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the store, None where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}") if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None


def has(keys: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """keys with existed: whether the store has them (PF-02, SC-12)."""
    if existing is None:
        return keys.withColumn("existed", F.lit(False))
    return keys.join(existing.select(key).distinct().withColumn("existed", F.lit(True)), key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def save(found: dict[str, DataFrame], folder: str, key: str = "patent_no", update: bool = False) -> None:
    """Adds the patents that a table doesn't have yet; with update those it has are replaced, and others aren't added. A second run changes nothing (SK-06, SK-07).

    Countries and kinds are numbered in the dimensions country and type, which keep the numbers they have. Tables with names of
    theirs are made once, as their names are read before they are.
    """
    spark, paths = next(iter(found.values())).sparkSession, []
    dimensions = (("country", "country", "country_no"), ("type", "type", "type_no"))
    for k, t in found.items():
        if any(dict(t.dtypes).get(name) == "string" for _, name, _ in dimensions):
            found = found | {k: (made := written(t))[0]}
            paths.append(made[1])
    for dimension, name, number in dimensions:
        own = [t.select(name) for t in found.values() if name in t.columns and dict(t.dtypes)[name] == "string"]
        if own:
            names = own[0]
            for t in own[1:]:
                names = names.union(t)
            settle(grown(stored(spark, folder, dimension), names, name, number)).write.mode("overwrite").parquet(f"{folder}/{dimension}")
        dims = stored(spark, folder, dimension)
        found = {k: t.join(F.broadcast(dims), name, "left").drop(name) if dims is not None and name in t.columns and dict(t.dtypes)[name] == "string" else t for k, t in found.items()}
    for k, t in found.items():
        now = stored(spark, folder, k)
        if now is None:
            if not update:
                t.write.parquet(f"{folder}/{k}")
        elif update:
            own = t.join(now.select(key).distinct(), key, "left_semi")
            settle(now.join(t.select(key).distinct(), key, "left_anti").unionByName(own)).write.mode("overwrite").parquet(f"{folder}/{k}")
        else:
            t.join(now.select(key).distinct(), key, "left_anti").write.mode("append").parquet(f"{folder}/{k}")
    for path in paths:
        deleted(spark, path)


def records(p: DataFrame) -> DataFrame:
    """(patent_no, html): a record as headed sections between rules (SK-01)."""
    shown = [(f, F.col(f)) for f in P.FIELDS if f in p.columns and not f.endswith("_raw")]
    return p.select(F.col("pat_no").alias("patent_no"), F.concat(F.lit("<html><body>\n"), F.array_join(F.array(*(F.concat(F.lit(f"<b>{f}</b>: "), F.coalesce(c, F.lit(""))) for f, c in shown)), "\n<HR>\n"), F.lit("\n</body></html>")).alias("html"))


def summary_pages(summaries: DataFrame) -> DataFrame:
    """(patent_no, html) of summaries (patent_no, sequence, type, summary), section by section (SK-02)."""
    rows = F.array_sort(F.collect_list(F.struct("sequence", F.concat(F.lit("<h3>"), "type", F.lit("</h3>\n"), F.coalesce("summary", F.lit(""))).alias("s"))))
    return summaries.groupBy("patent_no").agg(F.array_join(F.transform(rows, lambda x: x["s"]), "\n<HR>\n").alias("html"))


def claims_page(claims: Column) -> Column:
    """Claims as a list, those that lead in bold (TX-38)."""
    return F.array_join(F.transform(claims, lambda c: F.concat(F.lit("<p>"), F.when(c["leading"], F.concat(F.lit("<b>"), c["text"], F.lit("</b>"))).otherwise(c["text"]), F.lit("</p>"))), "\n")


def highlighted(text: Column, summary: Column, terms: Column) -> Column:
    """Paragraphs (array) with the sentences of a summary (array) marked and its terms in bold, whatever their case (TX-37)."""
    marked = F.transform(text, lambda p: F.when(F.array_contains(summary, p), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(p))
    pattern = F.concat(F.lit("(?i)\\b("), F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), "|"), F.lit(")\\b"))
    return F.when(F.size(terms) > 0, F.transform(marked, lambda p: F.regexp_replace(p, pattern, F.lit("<b>$1</b>")))).otherwise(marked)


_TAGS = "AU AF TI SO DE ID AB C1 CR NR TC J9 PY VL BP SC UT".split()


def wos_record(p: DataFrame) -> DataFrame:
    """(patent_no, record): a patent as a tagged record of 17 fields, assignees as authors, inventors by full name, classes as subjects, citations with their number (SK-04, TX-43)."""
    bare = lambda c: F.regexp_replace(c, r"(?m)\s*\([^)]+\)", "")
    of = P.routed(F.col("cites"))
    cites = F.concat(F.transform(of["us"], lambda c: P.cited("us", P.cited_patent(c))), F.transform(of["foreign"], lambda c: P.cited("foreign", P.cited_patent(c))), F.transform(of["other"], lambda c: P.cited("other", P.paper_reference(c))))
    places = F.transform(T.owners(F.col("assignee"), F.col("assignee_raw")), lambda o: F.array_join(F.array(F.regexp_replace(o["name"], "^([^,]*), ", "$1 "), F.coalesce(o["state"], F.lit("")), F.coalesce(o["city"], F.lit("Null")), o["country"]), ", "))
    values = {
        "AU": bare(F.regexp_replace("assignee", r"\)[^\n]", ")\n   ")), "AF": bare(F.replace(F.regexp_replace("inventors", r"\),", ")\n  "), F.lit(";"), F.lit(","))), "TI": F.col("title"), "SO": F.replace("intern_class", F.lit("&nbsp"), F.lit("")), "SC": F.replace("cpc_class", F.lit("&nbsp"), F.lit("")),
        "C1": F.array_join(places, "\n   "), "CR": F.array_join(cites, "\n   "), "NR": F.size(cites).cast("string"), "TC": F.lit("0"), "VL": F.lit("0"), "BP": F.lit("0"), "PY": F.regexp_replace("issued", r"^(\d{4}).+", "$1"), "UT": F.col("pat_no"),
    }
    lines = [F.concat(F.lit(f"{t} "), F.coalesce(values.get(t, F.lit("")), F.lit(""))) for t in _TAGS]
    return p.select(F.col("pat_no").alias("patent_no"), F.concat_ws("\n", F.lit("PT J"), *lines, F.lit("ER\n")).alias("record"))


def paper_record(p: DataFrame, order: list[str]) -> DataFrame:
    """(ut, record): rows of a bibliographic table as tagged records of 13 fields, numbered in their order (SK-05)."""
    listed = lambda c, sep: F.array_join(F.split(c, sep), "\n   ")
    values = {"AF": listed("authors", ", "), "TI": F.col("title"), "PY": F.col("year"), "SO": F.col("source"), "C1": F.array_join(F.transform(F.split("affiliations", "; "), T.address), "\n   "), "LA": F.col("language"), "J9": F.col("short_source"), "DT": F.col("kind"), "AB": F.col("abstract"), "DE": F.col("author_words"), "ID": F.col("index_words"), "CR": listed("references", "; ")}
    ranked = renumbered(p, order, "ut")
    lines = [F.concat(F.lit(f"{t} "), F.coalesce(v.cast("string"), F.lit(""))) for t, v in values.items()]
    return ranked.select("ut", F.concat_ws("\n", F.lit(""), *lines, F.concat(F.lit("UT ISI:"), F.col("ut").cast("string")), F.lit("ER\n")).alias("record"))
