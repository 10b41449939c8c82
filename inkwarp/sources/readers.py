"""Readers of the file formats that bibliographic and patent tools exchange."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkwarp.functions.patents import tree

PATENT_JSON = """patents array<struct<patent_id: string, patent_date: string, patent_title: string, patent_abstract: string,
 application: array<struct<application_id: string, filing_date: string>>,
 inventors: array<struct<inventor_sequence: int, inventor_name_last: string, inventor_name_first: string, inventor_city: string, inventor_country: string>>,
 assignees: array<struct<assignee_sequence: int, assignee_organization: string, assignee_city: string, assignee_country: string>>,
 cpc_at_issue: array<struct<cpc_sequence: int, cpc_group_id: string>>, cpc_current: array<struct<cpc_sequence: int, cpc_group_id: string>>>>""".replace("\n", "")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("line"))


def patent_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(patent_no): leading digits of the lines that aren't blank or remarks, commas dropped, each once, in order (SC-07, SC-08)."""
    lines = _raw_lines(spark, path).filter("not line rlike '^\\\\s*(#|$)'")
    return lines.select(F.regexp_extract(F.replace("line", F.lit(","), F.lit("")), r"^\s*(\d+)", 1).alias("patent_no")).filter("patent_no <> ''").distinct().orderBy("patent_no")


def patents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a patent from saved API answers, one a file or one a line, lists in the order of their sequence (SC-01, AG-12)."""
    p = spark.read.schema(PATENT_JSON).json(path, multiLine=not lines).select(F.explode("patents").alias("p")).select("p.*")

    def listed(column: str, sequence: str, *parts: str):
        rows = F.array_sort(F.transform(column, lambda x: F.struct(x[sequence].alias("k"), F.concat_ws(", ", *(x[q] for q in parts)).alias("v"))))
        return F.array_join(F.transform(rows, lambda x: x["v"]), "; ")

    first = F.try_element_at("application", F.lit(1))
    return p.select(
        F.col("patent_id").alias("patent_no"), F.to_date("patent_date").alias("issued_date"), F.col("patent_title").alias("title"), F.col("patent_abstract").alias("abstract"), first["application_id"].alias("apply_no"), F.to_date(first["filing_date"]).alias("apply_date"),
        listed("inventors", "inventor_sequence", "inventor_name_last", "inventor_name_first", "inventor_city", "inventor_country").alias("inventors"), listed("assignees", "assignee_sequence", "assignee_organization", "assignee_city", "assignee_country").alias("assignees"),
        listed("cpc_at_issue", "cpc_sequence", "cpc_group_id").alias("cpc_at_issue"), listed("cpc_current", "cpc_sequence", "cpc_group_id").alias("cpc_current"),
    )


def pages(spark: SparkSession, path: str, least: int = 1000, names: str = "*.htm*", end: str = "") -> DataFrame:
    """(path, html, complete): saved pages, also in folders below; complete: least characters or more (SC-09 to SC-11).

    end: what their writer puts after each page and is no part of it.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path, wholetext=True)
    # the engine counts a file as 4 MB at least and starts a task for a few dozen pages
    t = t.withColumn("path", F.col("_metadata.file_path")).coalesce(max(4 * spark.sparkContext.defaultParallelism, t.rdd.getNumPartitions() // 32))
    html = F.when(F.endswith("value", F.lit(end)), F.substring("value", F.lit(1), F.length("value") - len(end))).otherwise(F.col("value")) if end else F.col("value")
    return t.select("path", html.alias("html")).withColumn("complete", F.length("html") >= least)


def delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated records with a header (SC-13, SC-16); corrupt holds rows with another number of fields."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.col("value"), F.col("_metadata.file_path").alias("file")).filter(F.col("f")[0] != columns[0])
    ok = F.size("f") == len(columns)
    return lines.select(*(F.when(ok, F.get("f", F.lit(i))).alias(c) for i, c in enumerate(columns)), F.when(~ok, F.col("value")).alias("corrupt"), "file")


def bibliographic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with header, fields over several lines (SC-14)."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """(record, tag, value): records of two-letter tags, continuation lines indented by three blanks, ended by ER."""
    t = spark.read.option("lineSep", "\nER").text(path).withColumn("record", F.monotonically_increasing_id())
    fields = t.select("record", F.explode(F.split(F.regexp_replace("value", "\n   ", "; "), "\n")).alias("line"))
    return fields.select("record", F.regexp_extract("line", r"^([A-Z][A-Z0-9]) (.*)$", 1).alias("tag"), F.regexp_extract("line", r"^([A-Z][A-Z0-9]) (.*)$", 2).alias("value")).filter("tag <> ''")


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, label), edges (a, b) of labels in order) of a network file (SC-17, JN-10)."""
    line = F.trim("value")
    t = spark.read.text(path)
    v = t.select(F.regexp_extract(line, r'^(\d+)\s+"([^"]*)"', 1).alias("id"), F.regexp_extract(line, r'^(\d+)\s+"([^"]*)"', 2).alias("label")).filter("id <> ''")
    e = t.select(F.regexp_extract(line, r"^(\d+)\s+(\d+)", 1).alias("x"), F.regexp_extract(line, r"^(\d+)\s+(\d+)", 2).alias("y")).filter("x <> ''")
    e = e.join(v.toDF("x", "lx"), "x").join(v.toDF("y", "ly"), "y")
    return v, e.select(F.least("lx", "ly").alias("a"), F.greatest("lx", "ly").alias("b")).distinct()


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf) of "term TAB doc,tf,doc,tf," (SC-19)."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter("size(f) = 2")
    pair = t.select(F.col("f")[0].alias("term"), F.explode(F.regexp_extract_all(F.col("f")[1], F.lit(r"([^,]+),([^,]+)"), F.lit(0))).alias("p"))
    return pair.select("term", F.split("p", ",")[0].alias("doc_id"), F.split("p", ",")[1].cast("bigint").alias("tf"))


def listed_postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of "id : term : df : ..." with df above 0 (SC-18)."""
    f = F.split("value", " : ")
    return spark.read.text(path).select(F.get(f, F.lit(1)).alias("term"), F.try_to_number(F.get(f, F.lit(2)), F.lit("999999999")).cast("bigint").alias("df")).filter("df > 0")


def similarities(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, sim) of tab-separated pairs, i < j (SC-26)."""
    t = spark.read.csv(path, sep="\t", schema="i bigint, j bigint, sim double")
    return t.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): words between blanks, lines with # left out (PF-08)."""
    return spark.read.text(path).filter("not value like '#%'").select(F.explode(F.split(F.lower("value"), r"\s+")).alias("word")).filter("word <> ''").distinct()


def settings(path: str) -> dict[str, dict[str, list[str]]]:
    """Groups of key=value lines of a settings file; # and ; begin remarks, and a repeated key adds a value (SC-27 to SC-29)."""
    groups: dict[str, dict[str, list[str]]] = {"": {}}
    at = ""
    for line in Path(path).read_text(encoding="utf-8", errors="replace").splitlines():
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line[-1] == "]":
            at = line[1:-1].strip("'\"")
            groups.setdefault(at, {})
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            groups[at].setdefault(key.strip("'\""), []).append(value.strip("'\""))
    return groups


def search(rows: DataFrame, first: tuple[str, str], second: tuple[str, str] | None = None, op: str = "AND") -> DataFrame:
    """The rows whose field has a term, and, or or and not, another's, whatever the case; pairs are (field, term) (SC-03). count() gives the number of hits."""
    has = lambda x: F.lower(x[0]).contains(x[1].lower())
    if second is None:
        return rows.filter(has(first))
    return rows.filter({"AND": has(first) & has(second), "OR": has(first) | has(second), "ANDNOT": has(first) & ~F.coalesce(has(second), F.lit(False))}[op.upper().replace(" ", "")])


def hits(found: DataFrame, order: list, n: int = 200) -> DataFrame:
    """The first n hits with their place (SC-05); an n-th hit is that of the place (SC-04)."""
    return found.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def valid(page: Column, fields: Column, bytes_: int = 500, least: int = 5) -> Column:
    """Whether a fetched page can be one: bytes_ or more, and so many parsed fields (SC-04)."""
    return (F.coalesce(F.octet_length(page), F.lit(0)) >= bytes_) & (fields >= least)


def related_records(spark: SparkSession, path: str, columns: list[str], useful: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts of files and rows) of tab-separated exports (SC-13, AG-16).

    Files without the header of these columns are skipped; so are rows with another number of fields, and both are counted:
    (file, good, rows, mismatched). useful: positions of the columns to keep (PF-01).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value")).filter("value <> ''")
    head = F.col("value") == "\t".join(columns)
    fields = F.split("value", "\t", -1)
    ok = ~head & (F.size(fields) == len(columns))
    files = lines.groupBy("file").agg(F.bool_or(head).alias("good"), F.count_if(ok).alias("rows"), F.count_if(~head & ~ok).alias("mismatched"))
    good = files.filter("good").select("file")
    kept = range(len(columns)) if useful is None else useful
    rows = lines.filter(ok).join(F.broadcast(good), "file", "left_semi").select("file", *(F.get(fields, F.lit(i)).alias(columns[i]) for i in kept))  # a row a file
    return rows, files


def scopus(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns of a bibliographic CSV that records need, by position, and the file's header skipped (SC-14)."""
    names = {0: "authors", 3: "title", 4: "year", 5: "source", 16: "affiliations", 17: "abstract", 18: "author_words", 19: "index_words", 26: "references", 39: "language", 40: "short_source", 41: "kind"}
    t = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return t.select(*(F.col(f"`{t.columns[i]}`").alias(n) for i, n in names.items()))


def rank_table(html: Column) -> Column:
    """array<array<string>>: the cells of a page's data table, numbers repaired; the last row is none (SC-15)."""
    rows = F.split(F.get(F.split(html, '<table class="tabla_datos">'), F.lit(1)), "</tr>")

    def cells(row: Column) -> Column:
        bare = F.transform(F.split(row, "</t[dh]>"), lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"^\s+|\s+$", ""), "(?s)^.*>", ""))
        some = F.filter(bare, lambda c, i: ~((i == 1) & (c == "")))
        some = F.when(F.element_at(some, -1) == "", F.slice(some, F.lit(1), F.size(some) - 1)).otherwise(some)
        return F.transform(some, lambda c: F.regexp_replace(F.when(c.rlike(r"\d+\.\d+"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c), r"(\d),(\d)", "$1.$2"))

    return F.transform(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), cells)


def yearly(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated tables of a year each, the year from the name of file or folder; headers are left out (SC-16, SC-24)."""
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(F.split("value", "\t", -1).alias("f"), F.regexp_extract(F.col("_metadata.file_path"), r"(?:year=|/)(\d{4})(?:\.txt|/)", 1).cast("int").alias("year"))
    rows = t.filter(F.get("f", F.lit(0)) != columns[0])
    return rows.select("year", *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def posting_counts(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of comma-form postings: half of the commas (SC-19)."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(f) == 2).select(f[0].alias("term"), F.floor((F.length(f[1]) - F.length(F.replace(f[1], F.lit(","), F.lit("")))) / 2).cast("bigint").alias("df"))


def term_counts(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of "term TAB df"; of lines of one term the last holds (SC-20)."""
    f = F.split("value", "\t")
    t = spark.read.text(path).filter("trim(value) <> ''").select(f[0].alias("term"), F.get(f, F.lit(1)).cast("bigint").alias("df"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return t.groupBy("term").agg(F.max_by("df", "at").alias("df"))


def jdbc(spark: SparkSession, url: str, table: str, longest: int = 1_280_000, **options: str) -> DataFrame:
    """A table of a database; texts are cut at longest characters (SC-21)."""
    t = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return t.select(*(F.substring(c, 1, longest).alias(c) if kind == "string" else F.col(c) for c, kind in t.dtypes))


def cluster_source(rows: DataFrame) -> DataFrame:
    """(id, sno, fname, dname, dscpt) of what is to be clustered, in one scan (SC-22)."""
    return rows.select("id", "sno", "fname", "dname", "dscpt").filter("id is not null")


def listing(spark: SparkSession, path: str, text_only: bool = False) -> DataFrame:
    """(path, size) of files below a folder, hidden ones left out; with text_only those that end in htm, html or txt (SC-25). Contents aren't read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    t = t.filter(~F.col("path").rlike(r"/\.[^/]*$"))
    return t.filter(F.col("path").rlike(r"(?i)\.(html?|txt)$")) if text_only else t


def distances(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, label_i, label_j, dist), i > j: a table of a size, labels, and a lower triangle, one value a line (SC-26).

    Blank lines and remarks are skipped. A table with another number of values than its size asks for is an error.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    t = spark.read.text(path, wholetext=True).select(lines.alias("x")).withColumn("n", F.trim(F.col("x")[0]).cast("int"))
    want = 1 + F.col("n") + (F.col("n") * (F.col("n") - 1) / 2).cast("int")
    whole = F.when(F.size("x") == want, F.col("x")).otherwise(F.raise_error(F.lit("values are missing in the table of distances")).cast("array<string>"))
    t = t.withColumn("x", whole)
    cells = t.select("x", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i")).select("x", "n", "i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
    return cells.select("i", "j", F.col("x")[F.col("i") + 1].alias("label_i"), F.col("x")[F.col("j") + 1].alias("label_j"), F.trim(F.col("x")[(1 + F.col("n") + F.col("i") * (F.col("i") - 1) / 2 + F.col("j")).cast("int")]).cast("double").alias("dist"))


def placed(spark: SparkSession, path: str, labels: DataFrame, k: int) -> DataFrame:
    """(label, at): first coordinates of a map from a file of a dimension, then a label and its values for each item (JN-11, CL-11).

    Another dimension than k, a label that isn't among labels, and one of these without values are errors.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    t = spark.read.text(path, wholetext=True).select(lines.alias("x"))
    t = t.withColumn("x", F.when((F.trim(F.col("x")[0]).cast("int") == k) & ((F.size("x") - 1) % (k + 1) == 0), F.col("x")).otherwise(F.raise_error(F.lit("another dimension, or missing values")).cast("array<string>")))
    at = t.select("x", F.explode(F.sequence(F.lit(1), F.size("x") - 1, F.lit(k + 1))).alias("i")).select(F.col("x")[F.col("i")].alias("label"), F.transform(F.slice("x", F.col("i") + 2, F.lit(k)), lambda v: F.trim(v).cast("double")).alias("at"))
    both = labels.select("label", F.lit(True).alias("known")).join(at.withColumn("given", F.lit(True)), "label", "full")
    fine = F.when(F.col("known") & F.col("given"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no values or no item for label "), "label")))
    return both.select(fine.alias("label"), "at")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def result_lists(html: pd.Series) -> pd.Series:
    """Columns 1 and 3 of the rows of a page's tables, header rows skipped (SC-23)."""

    def rows(page: str) -> list[list[str]]:
        found, waiting = [], [tree(page)]
        while waiting:
            n = waiting.pop()
            below = [c for c in n.children if not isinstance(c, str)]
            if n.tag == "tr":
                cells = [c.text().strip() for c in below if c.tag == "td"]
                if len(cells) > 3:
                    found.append([cells[1], cells[3]])
            waiting += reversed(below)
        return found

    return pd.Series([rows(h) if isinstance(h, str) else [] for h in html])


def first_settings(paths: list[str]) -> dict[str, dict[str, list[str]]]:
    """The settings of the first file that exists; none gives none (SC-27)."""
    return next((settings(p) for p in paths if Path(p).exists()), {"": {}})


def overlaid(groups: dict[str, dict[str, list[str]]], group: str) -> dict[str, list[str]]:
    """Settings outside groups with those of a group over them; lists between commas are split (SC-29)."""
    own = groups.get("", {}) | groups.get(group, {})
    return {k: [x.strip() for v in values for x in v.split(",") if x.strip()] for k, values in own.items()}


def grep(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """The rows of which a column has a pattern (PF-06)."""
    return rows.filter(F.col(column).rlike(pattern))
