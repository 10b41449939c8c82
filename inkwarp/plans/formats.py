"""Queries on readers and writers: the driver's tables are written in a format and read back, or composed as text and parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.functions import text as T
from inkwarp.operators import counting as K
from inkwarp.operators import store as R
from inkwarp.plans.registry import query
from inkwarp.session import settle, shared_folder, table
from inkwarp.sources import readers as I
from inkwarp.sources import writers as O
from inkwarp.streaming import incremental as M


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, line: str, path: str) -> str:
    """One text file for each partition of rows."""
    rows.select(F.expr(line).alias("value")).write.text(path)
    return path


def _composed(spark: SparkSession, d: str, of: str, **columns: str) -> DataFrame:
    return table(spark, d, of).select(*(F.expr(v).alias(c) for c, v in columns.items()))


@query("sc07_patent_numbers", "SELECT DISTINCT '' || (5000000 + c_custkey) AS patent_no FROM customer")
def patent_numbers(spark, d):
    lines = "CASE o_orderkey % 4 WHEN 0 THEN '# remark' WHEN 1 THEN '' ELSE '' END || CASE WHEN o_orderkey % 4 > 1 THEN '  ' || substr('' || (5000000 + c_custkey), 1, 1) || ',' || substr('' || (5000000 + c_custkey), 2, 6) || '  note' || chr(13) || '' || (5000000 + c_custkey) ELSE '' END"
    rows = table(spark, d, "customer").withColumn("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return I.patent_numbers(spark, _lines(rows, lines, _folder(spark)))


_API = "SELECT 'P' || c_custkey AS patent_no, make_date(2001, 1 + c_nationkey % 12, 5)::VARCHAR AS issued_date, 'T ' || c_custkey AS title, 'A ' || c_name AS abstract, '10/' || c_custkey AS apply_no, '2000-02-03' AS apply_date, 'Aa, B' || c_custkey || ', Rome, IT; Zz, Y, Oslo, NO' AS inventors, 'Org ' || c_custkey || ', Bonn, DE' AS assignees, 'H01L; G06F' AS cpc_at_issue, 'A1' AS cpc_current FROM customer"


@query("sc01_api_answers", _API)
def api_answers(spark, d):
    """Answers of an interface, written as JSON with lists out of order."""
    at = lambda f, *x: F.struct(*(F.expr(v).alias(k) for k, v in x), F.expr(f[1]).alias(f[0]))
    c = table(spark, d, "customer")
    inventor = lambda seq, last, first, city, country: at(("inventor_sequence", seq), ("inventor_name_last", last), ("inventor_name_first", first), ("inventor_city", city), ("inventor_country", country))
    cpc = lambda seq, group: at(("cpc_sequence", seq), ("cpc_group_id", group))
    p = F.struct(
        F.expr("'P' || c_custkey").alias("patent_id"), F.expr("cast(make_date(2001, 1 + c_nationkey % 12, 5) as string)").alias("patent_date"), F.expr("'T ' || c_custkey").alias("patent_title"), F.expr("'A ' || c_name").alias("patent_abstract"),
        F.array(at(("application_id", "'10/' || c_custkey"), ("filing_date", "'2000-02-03'"))).alias("application"), F.array(inventor("1", "'Zz'", "'Y'", "'Oslo'", "'NO'"), inventor("0", "'Aa'", "'B' || c_custkey", "'Rome'", "'IT'")).alias("inventors"),
        F.array(at(("assignee_sequence", "0"), ("assignee_organization", "'Org ' || c_custkey"), ("assignee_city", "'Bonn'"), ("assignee_country", "'DE'"))).alias("assignees"), F.array(cpc("1", "'G06F'"), cpc("0", "'H01L'")).alias("cpc_at_issue"), F.array(cpc("0", "'A1'")).alias("cpc_current"),
    )
    path = _folder(spark)
    c.select(F.array(p).alias("patents")).write.json(path)
    return I.patents(spark, path, lines=True).withColumns({c: F.col(c).cast("string") for c in ("issued_date", "apply_date")})


@query("sc03_search_count", "SELECT 'AND' AS op, count(*) AS n FROM documents WHERE lower(text) LIKE '%the%' AND lower(source) LIKE '%1%' UNION ALL SELECT 'OR', count(*) FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%1%' UNION ALL SELECT 'ANDNOT', count(*) FROM documents WHERE lower(text) LIKE '%the%' AND NOT coalesce(lower(source) LIKE '%1%', false)")
def search_count(spark, d):
    t, found = table(spark, d, "documents"), None
    for op, word in (("AND", "The"), ("OR", "LICENSE"), ("ANDNOT", "the")):
        one = I.search(t, ("text", word), ("source", "1"), op).agg(F.lit(op).alias("op"), F.count("*").alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


@query("sc05_first_hits", "SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE lower(text) LIKE '%the%') WHERE place <= 200")
def first_hits(spark, d):
    """The first 200 hits are a report."""
    return I.hits(I.search(table(spark, d, "documents").select("doc_id", "text", "n_chars"), ("text", "the")), [F.desc("n_chars"), "doc_id"]).select("doc_id", F.col("place").cast("bigint").alias("place"))


@query("sc04_valid_pages", "SELECT page_id, octet_length(encode(html)) >= 500 AND 5 <= (CASE WHEN html LIKE '%<title%' THEN 1 ELSE 0 END + CASE WHEN html LIKE '%<h1%' THEN 1 ELSE 0 END + CASE WHEN html LIKE '%<p%' THEN 1 ELSE 0 END + CASE WHEN html LIKE '%<a %' THEN 1 ELSE 0 END + CASE WHEN html LIKE '%<html%' THEN 1 ELSE 0 END) AS valid FROM pages")
def valid_pages(spark, d):
    fields = sum((F.col("html").contains(x).cast("int") for x in ("<title", "<h1", "<p", "<a ", "<html")), F.lit(0))
    return table(spark, d, "pages").select("page_id", I.valid(F.col("html"), fields).alias("valid"))


@query("sc06_missing_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_keys(spark, d):
    return R.has(table(spark, d, "documents").select("doc_id").distinct(), table(spark, d, "labels"), "doc_id").filter("not existed").select("doc_id")


@query("pf02_existed", "SELECT DISTINCT doc_id, doc_id IN (SELECT doc_id FROM labels) AS existed FROM documents")
def existed(spark, d):
    return R.has(table(spark, d, "documents").select("doc_id").distinct(), table(spark, d, "labels"), "doc_id")


@query("sc11_saved_pages", "SELECT md5(html) AS page, length(html) >= 1000 AS complete, count(*) AS n FROM pages GROUP BY ALL")
def saved_pages(spark, d):
    path = _folder(spark)
    O.write_pages(table(spark, d, "pages"), path, "\x00")
    found = I.pages(spark, path, names="part-*", end="\x00")
    return found.groupBy(F.md5("html").alias("page"), "complete").agg(F.count("*").alias("n"))


_HEAD = [f"F{i}" for i in range(37)] + ["UT"]
_EXPORT = "o_orderkey || repeat(chr(9) || o_orderstatus, 35) || chr(9) || o_orderpriority || CASE WHEN o_orderkey % 50 = 0 THEN chr(9) || 'extra' ELSE '' END || chr(9) || 'UT' || (o_orderkey % 1000)"


def _exports(spark: SparkSession, d: str) -> str:
    """Four exports of orders by year of date; one has another header."""
    folder = _folder(spark)
    rows = table(spark, d, "orders")
    for part in range(4):
        own = rows.filter(F.pmod(F.col("o_custkey"), F.lit(4)) == part)
        head = "\t".join(_HEAD if part < 3 else _HEAD[::-1])
        spark.range(1).select(F.lit(head).alias("value")).union(own.select(F.expr(_EXPORT).alias("value"))).coalesce(1).write.text(f"{folder}/{part}")
    return f"{folder}/*"


@query("sc13_related_records", "SELECT '' || o_orderkey AS f0, o_orderpriority AS f36, 'UT' || (o_orderkey % 1000) AS ut FROM orders WHERE o_custkey % 4 < 3 AND o_orderkey % 50 <> 0")
def related_records(spark, d):
    rows, _ = I.related_records(spark, _exports(spark, d), _HEAD, [0, 36, 37])
    return rows.select(F.col("F0").alias("f0"), F.col("F36").alias("f36"), F.col("UT").alias("ut"))


@query("ag16_record_counts", "SELECT o_custkey % 4 < 3 AS good, count(*) FILTER (o_orderkey % 50 <> 0) + CASE WHEN o_custkey % 4 = 3 THEN 1 ELSE 0 END AS rows, count(*) FILTER (o_orderkey % 50 = 0) AS mismatched FROM orders GROUP BY o_custkey % 4")
def record_counts(spark, d):
    return I.related_records(spark, _exports(spark, d), _HEAD)[1].select("good", "rows", "mismatched")


_BIB = {0: "p_brand || ', X.'", 3: "p_name", 4: "1990 + p_size", 5: "'Source \"' || p_type || '\"'", 16: "'Ab, C., Dept ' || p_size || ', Univ, Town, Land; De, F., Lab, Inst, City, Zip, State'", 17: "'Line one' || chr(10) || 'line two, ' || p_partkey", 18: "'k1; k2'", 19: "p_type", 26: "'Ref A, ' || p_size || '; Ref B'", 39: "'English'", 40: "'Src.'", 41: "'Article'"}


def _bibliography(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    t = table(spark, d, "part")
    t.select(*(F.expr(_BIB.get(i, "cast(null as string)")).cast("string").alias(f"H{i}") for i in range(46))).write.csv(path, header=True, quoteAll=True, escape='"')
    return I.scopus(spark, path)


@query("sc14_bibliographic_csv", f"SELECT {_BIB[0]} AS authors, {_BIB[3]} AS title, '' || ({_BIB[4]}) AS year, {_BIB[5]} AS source, {_BIB[16]} AS affiliations, {_BIB[17]} AS abstract, {_BIB[18]} AS author_words, {_BIB[19]} AS index_words, {_BIB[26]} AS \"references\", {_BIB[39]} AS language, {_BIB[40]} AS short_source, {_BIB[41]} AS kind FROM part")
def bibliographic_csv(spark, d):
    return _bibliography(spark, d)


@query("sk05_paper_records", f"""SELECT row_number() OVER (ORDER BY {_BIB[17]}) AS ut, chr(10) || 'AF ' || p_brand || chr(10) || '   X.' || chr(10) || 'TI ' || p_name || chr(10) || 'PY ' || ({_BIB[4]}) || chr(10) || 'SO ' || {_BIB[5]} || chr(10) || 'C1 [Ab, C.] Univ, Dept ' || p_size || ', Town, Land.' || chr(10) || '   [De, F.] Inst, Lab, City, State.' || chr(10) || 'LA English' || chr(10) || 'J9 Src.' || chr(10) || 'DT Article' || chr(10) || 'AB ' || {_BIB[17]} || chr(10) || 'DE k1; k2' || chr(10) || 'ID ' || p_type || chr(10) || 'CR Ref A, ' || p_size || chr(10) || '   Ref B' || chr(10) || 'UT ISI:' || row_number() OVER (ORDER BY {_BIB[17]}) || chr(10) || 'ER' || chr(10) AS record FROM part""")
def paper_records(spark, d):
    return R.paper_record(_bibliography(spark, d), ["abstract"])


_RANKS = "'<html><table><tr><td>x</td></tr></table><table class=\"tabla_datos\"><thead><tr><th></th><th>Country</th><th>Documents</th><th>Per</th></tr>' || '<tr><td>' || (n_nationkey + 1) || '</td><td><a href=\"#\">' || n_name || '</a></td><td> 1.' || (100 + n_nationkey) || ' </td><td>0,' || (10 + n_nationkey) || '</td></tr></tbody></table>'"


@query("sc15_rank_tables", "SELECT n_nationkey AS page, 1 AS place, '' || (n_nationkey + 1) AS rank, n_name AS country, '' || (1100 + n_nationkey) AS documents, '0.' || (10 + n_nationkey) AS per FROM nation")
def rank_tables(spark, d):
    t = _composed(spark, d, "nation", page="n_nationkey", html=_RANKS).select("page", F.posexplode(I.rank_table(F.col("html"))).alias("place", "cells"))
    return t.filter("place > 0").select("page", "place", *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("rank", "country", "documents", "per"))))


def _by_year(spark: SparkSession, d: str) -> str:
    path = _folder(spark)
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    t = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("year"), F.col("n_name").alias("country")).agg(F.count("*").alias("documents"))
    O.write_by_year(t, path)
    return path


_YEARLY = "SELECT year(o_orderdate) AS year, n_name AS country, count(*) AS documents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


@query("sk14_yearly_tables", _YEARLY)
def yearly_tables(spark, d):
    t = I.yearly(spark, _by_year(spark, d), ["country", "documents"])
    return t.select(F.col("year").cast("bigint").alias("year"), "country", F.col("documents").cast("bigint").alias("documents"))


@query("jn09_top_report", f"WITH t AS ({_YEARLY}), top AS (SELECT country FROM t WHERE year = (SELECT max(year) FROM t) ORDER BY documents DESC, country LIMIT 12) SELECT year, country, documents FROM t WHERE country IN (SELECT country FROM top)")
def top_report(spark, d):
    """The report of the twelve first countries, from the files of the years."""
    t = settle(I.yearly(spark, _by_year(spark, d), ["country", "documents"]).withColumn("documents", F.col("documents").cast("bigint")))
    wide = K.report(t, "year", "country", "documents", "documents", 12)
    return wide.unpivot("year", wide.columns[1:], "country", "documents").filter("documents is not null").withColumn("year", F.col("year").cast("bigint"))


@query("sk20_network_file", "SELECT least(n_name, 'N' || r_name) AS a, greatest(n_name, 'N' || r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def network_file(spark, d):
    path = _folder(spark)
    e = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.expr("'N' || r_name").alias("b"), F.lit(1).alias("weight"))
    O.write_pajek(e.select(F.col("a").alias("label")).union(e.select("b")), e, path)
    return I.pajek(spark, path)[1]


_PAIRS = "SELECT l_suppkey AS s, l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY ALL"


@query("sc19_posting_counts", "SELECT 't' || l_suppkey AS term, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY l_suppkey")
def posting_counts(spark, d):
    return I.posting_counts(spark, _postings(spark, d))


def _postings(spark: SparkSession, d: str) -> str:
    p = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.array_join(F.collect_list(F.concat_ws(",", "l_orderkey", "n")), ",").alias("x"))
    return _lines(p, "'t' || l_suppkey || chr(9) || x || ','", _folder(spark))


@query("sc19_postings", f"SELECT 't' || s AS term, '' || o AS doc_id, n AS tf FROM ({_PAIRS})")
def postings(spark, d):
    return I.postings(spark, _postings(spark, d))


@query("sc18_listed_postings", "SELECT p_type AS term, count(*) AS df FROM part GROUP BY p_type")
def listed_postings(spark, d):
    t = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("n", F.explode(F.array("n", F.lit(0))))
    return I.listed_postings(spark, _lines(t, "'7 : ' || p_type || ' : ' || n || ' : 1' || chr(9) || '2'", _folder(spark)))


@query("sc20_term_counts", "SELECT p_brand AS term, max(p_partkey) AS df FROM part GROUP BY p_brand")
def term_counts(spark, d):
    t = table(spark, d, "part").coalesce(1).sortWithinPartitions("p_partkey")
    return I.term_counts(spark, _lines(t, "p_brand || chr(9) || p_partkey", _folder(spark)))


@query("sc22_cluster_source", "SELECT doc_id AS id, source AS sno, lang AS fname, left(text, 20) AS dname, length(text) AS n FROM documents")
def cluster_source(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("sno"), F.col("lang").alias("fname"), F.substring("text", 1, 20).alias("dname"), F.col("text").alias("dscpt"))
    return I.cluster_source(t).select("id", "sno", "fname", "dname", F.length("dscpt").cast("bigint").alias("n"))


@query("sk17_result_lists", "SELECT n_name AS no, 'R ' || n_regionkey AS title FROM nation UNION ALL SELECT 'US' || n_nationkey, '' FROM nation")
def result_lists(spark, d):
    html = "'<table><tr><th>a<th>b<th>c<th>d</tr><tr><td>1<td> ' || n_name || ' </td><td>x<td>R ' || n_regionkey || '<td>y</tr><tr><td>2</td><td>US' || n_nationkey || '</td><td></td><td></td></tr></table>'"
    t = _composed(spark, d, "nation", html=html).select(F.explode(I.result_lists("html")).alias("r")).select(F.col("r")[0].alias("no"), F.col("r")[1].alias("title"))
    path = _folder(spark)
    O.two_columns(t, path)
    return spark.read.csv(path, header=True, escape='"').fillna("")


@query("sc25_listing", "SELECT count(DISTINCT c_nationkey) AS files, sum(length(c_name) + 1)::BIGINT AS bytes FROM customer")
def listing(spark, d):
    path = _folder(spark)
    table(spark, d, "customer").repartition("c_nationkey").select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(path)
    return I.listing(spark, path).filter("path like '%part-%'").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("sc26_distances", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_name AS label_i, b.n_name AS label_j, (a.n_nationkey - b.n_nationkey)::DOUBLE AS dist FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey")
def distances(spark, d):
    n = table(spark, d, "nation")
    cells = n.alias("a").join(n.alias("b"), F.col("a.n_nationkey") > F.col("b.n_nationkey")).select(F.struct(F.lit(2), F.col("a.n_nationkey"), F.col("b.n_nationkey")).alias("at"), (F.col("a.n_nationkey") - F.col("b.n_nationkey")).cast("double").cast("string").alias("v"))
    names = n.select(F.struct(F.lit(1), "n_nationkey", F.lit(0)).alias("at"), F.col("n_name").alias("v"))
    size = n.agg(F.count("*").cast("string").alias("v")).select(F.struct(F.lit(0), F.lit(0), F.lit(0)).alias("at"), "v")
    return I.distances(spark, _lines(size.union(names).union(cells).orderBy("at").coalesce(1), "v", _folder(spark)))


@query("jn11_placed_labels", "SELECT n_name AS label, n_nationkey::DOUBLE AS x, n_regionkey / 2 AS y FROM nation")
def placed_labels(spark, d):
    t = table(spark, d, "nation").coalesce(1).select(F.explode(F.array("n_name", F.col("n_nationkey").cast("string"), (F.col("n_regionkey") / 2).cast("string"))).alias("v"))
    path = _lines(spark.range(1).select(F.lit("2").alias("v")).union(t).coalesce(1), "v", _folder(spark))
    return I.placed(spark, path, table(spark, d, "nation").select(F.col("n_name").alias("label")), 2).select("label", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


@query("sk03_csv_append", "SELECT * FROM (SELECT c_name AS name, 'say \"' || c_mktsegment || '\", twice' AS note FROM customer UNION ALL SELECT s_name, 'x' FROM supplier)")
def csv_append(spark, d):
    path = _folder(spark)
    O.append_csv(_composed(spark, d, "customer", name="c_name", note="'say \"' || c_mktsegment || '\", twice'"), path)
    O.append_csv(_composed(spark, d, "supplier", name="s_name", note="'x'"), path)
    return spark.read.csv(path, header=True, escape='"')


@query("jn02_segments_reload", "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def segments_reload(spark, d):
    """A table loaded twice has what the second load had."""
    path, docs = _folder(spark), table(spark, d, "documents").select("doc_id", "source")
    O.replaced(docs, path)
    O.replaced(docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id"), path)
    return spark.read.parquet(path)


@query("sk19_shown_document", "SELECT doc_id, '<html><head><title>' || source || '</title></head><body>' || replace(text, chr(10), '<p>' || chr(10)) || '</body></html>' AS page FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def shown_document(spark, d):
    t = table(spark, d, "documents")
    return O.shown(t, "doc_id", t.agg(F.min("doc_id")).first()[0], "text", "source")


@query("sk18_line_ends", "SELECT doc_id, text AS text FROM documents")
def line_ends(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unix_lines(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("text"))


@query("pf06_grep", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icen[cs]e|[0-9]{4}')")
def grep(spark, d):
    return I.grep(table(spark, d, "documents"), "text", "[Ll]icen[cs]e|[0-9]{4}").select("doc_id")


@query("pf10_title_abstract", "SELECT o_orderkey, 'T' || o_orderkey || repeat(chr(10), 5) || CASE WHEN o_orderkey % 2 = 0 THEN ' Abstract of it' || repeat(chr(10), 5) ELSE '' END AS text FROM orders")
def title_abstract(spark, d):
    text = "'T' || o_orderkey || repeat(chr(10), 5) || CASE WHEN o_orderkey % 2 = 0 THEN ' Abstract of it' ELSE 'Claims' END || repeat(chr(10), 5) || 'rest'"
    return _composed(spark, d, "orders", o_orderkey="o_orderkey", text=text).select("o_orderkey", T.title_and_abstract(F.col("text")).alias("text"))


@query("st01_incremental_files", "SELECT c_custkey FROM customer")
def incremental_files(spark, d):
    """Files that come in two batches, read once each by a stream that is stopped between."""
    folder, schema = _folder(spark), "c_custkey bigint"
    t = table(spark, d, "customer").select("c_custkey")
    for part in range(2):
        t.filter(F.pmod("c_custkey", F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        M.new_rows(spark, f"{folder}/in", schema, ["c_custkey"]).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("st02_repeated_keys", "SELECT DISTINCT o_custkey FROM orders")
def repeated_keys(spark, d):
    """Files that repeat keys, each key kept once over all triggers."""
    folder = _folder(spark)
    table(spark, d, "orders").select("o_custkey").repartition(4).write.parquet(f"{folder}/in")
    M.new_rows(spark, f"{folder}/in", "o_custkey bigint", ["o_custkey"], 1).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("o_custkey bigint").parquet(f"{folder}/out")


@query("st03_regression_sums", "SELECT sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS n, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END)::BIGINT AS sx, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END)::BIGINT AS sy, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey * c_nationkey END)::BIGINT AS sxx, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey * c_custkey END)::BIGINT AS sxy FROM customer")
def regression_sums(spark, d):
    """Observations one by one, a third of them taken back; the sums after the last trigger."""
    folder, schema = _folder(spark), "c_custkey bigint, c_nationkey bigint, weight int"
    t = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), F.lit(1).alias("weight"))
    t.union(t.filter("c_custkey % 3 = 0").withColumn("weight", F.lit(-1))).repartition(3).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    M.regression_sums(rows, "c_custkey", "c_nationkey").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
