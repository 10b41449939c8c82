"""Queries on patents. The pages are composed of the driver's customers in SQL that both engines read; the parsed pages must have what they were composed of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.functions import text as T
from inkwarp.operators import store as R
from inkwarp.plans.registry import query
from inkwarp.session import deleted, scattered, shared_folder, table, written
from inkwarp.sources import readers as I
from inkwarp.sources import writers as O

BR = "<BR><BR>"
_BASE = "(SELECT c_custkey AS k, c_name AS name, lower(c_mktsegment) AS seg, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_MONTH = "split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', CAST(k % 12 + 1 AS INT))"
_STATE = "split_part('TX,CA,NY', ',', CAST(k % 3 + 1 AS INT))"
#: What a patent is composed of.
PIECES = {
    "no": "'' || (7000000 + k)",
    "long": f"{_MONTH} || ' ' || (1 + k % 28) || ', ' || (1995 + k % 10)",
    "slash": "(1995 + k % 10) || '/' || lpad('' || (k % 12 + 1), 2, '0') || '/' || (1 + k % 28)",
    "title": "'Method for ' || seg || ' device ' || k",
    "abstract": "'A text of ' || name || '. It works.'",
    "inventors": f"'Lee' || k || '; Ann (Dallas, ' || {_STATE} || '), Kim; Bo (City' || k % 7 || ', ' || nation || ')'",
    "assignee": "CASE k % 4 WHEN 0 THEN name || ' Ltd. (' || nation || ')' WHEN 1 THEN name || ' Inc. (Austin, TX)' WHEN 2 THEN 'Group ' || name || ' (Oslo, ' || nation || ')' ELSE name || ' GmbH (Bonn, DE)' END",
    "bold": "CASE k % 4 WHEN 3 THEN name || ' GmbH (Bonn, <B>DE</B>)' END",
    "apply_no": "(10 + k % 5) || '/' || (100000 + k)",
    "us_class": "(k % 5) || '/' || (k % 11) || '; ' || (k % 7) || '/9'",
    "intern_class": "'H01L 021/' || (k % 90)",
    "search": "(k % 5) || '/1,2'",
}
_US = ["(4000000 + k) || chr(9) || 'Oct., 1978' || chr(9) || 'Doe' || k || ' et al.' || chr(9) || (k % 9) || '/45.'", "(4100000 + k) || chr(9) || 'Jan., 1990' || chr(9) || 'Roe.' || chr(9) || '7/8'"]
_FOREIGN = ["'EP' || k || chr(9) || 'May., 1991' || chr(9) || 'EP.' || chr(9) || 'X/1'"]
_OTHER = ["'Smith, J., \"On widgets of ' || seg || ',\" Journal of Widgets, vol. ' || (k % 30 + 1) || ', p. ' || (k % 400 + 1) || ', 1988.'"]
CLAIMS = f"'1. A device of kind ' || k || '.{BR}2. The device of claim 1.{BR}with a lid{BR}   {BR}3. A method.' || CASE WHEN k % 2 = 0 THEN '{BR}4. The method of Claim 3.' ELSE '' END"
#: Three kinds of description: with a field; without, but with numbered subsections; with neither.
DESCRIPTION = f"""CASE k % 3 WHEN 0 THEN 'FIELD OF THE INVENTION{BR}The field of ' || seg || '.{BR}BACKGROUND{BR}It was so  ' || k || '.{BR}More of it.'
 WHEN 1 THEN 'BACKGROUND OF THE INVENTION{BR}1. Field of it{BR}A field of ' || seg || '.{BR}2. Related Art{BR}Prior of ' || k || '.{BR}And more.'
 ELSE 'BACKGROUND{BR}First of ' || k || '.{BR}Second.{BR}Third.' END || '{BR}SUMMARY{BR}In sum ' || k || '.{BR}BRIEF DESCRIPTION OF THE DRAWINGS{BR}FIG. 1 shows it.{BR}SUMMARY OF DESCRIPTION{BR}Overwritten.{BR}DETAILED DESCRIPTION{BR}In detail ' || k || '.{BR}Again.{BR}* * * * *'"""


def _row(*cells: str) -> str:
    return "<TR>" + "".join(f"<TD>' || {c} || '</TD>" for c in cells)


def _cells(cite: str) -> str:
    return "'<TR><TD>' || replace(" + cite + ", chr(9), '</TD><TD>') || '</TD></TR>'"


_PAIR = lambda label, value: f"'<TR><TH>{label}</TH><TD>' || {value} || '</TD></TR>'"
OLD = " || '<HR>' || ".join([
    f"'<TITLE>United States Patent: ' || {PIECES['no']} || '</TITLE>'",
    f"'<TABLE><TR><TD>United States Patent</TD><TD><B> ' || {PIECES['no']} || ' </B></TD></TR><TR><TD>' || {PIECES['long']} || '</TD></TR></TABLE>'",
    f"'<font size=\"+1\"> ' || {PIECES['title']} || '</font><BR><CENTER><B>Abstract</B></CENTER><P>' || ({PIECES['abstract']}) || '</P>'",
    "'<TABLE>' || " + " || ".join([_PAIR("Inventors:", PIECES["inventors"]), _PAIR("Assignee:", f"coalesce({PIECES['bold']}, {PIECES['assignee']})"), _PAIR("Appl. No.:", PIECES["apply_no"]), _PAIR("Filed:", PIECES["long"])]) + " || '</TABLE>'",
    "'<TABLE>' || " + " || ".join([_PAIR("Current U.S. Class:", PIECES["us_class"]), _PAIR("Intern''l Class:", PIECES["intern_class"]), _PAIR("Field of Search:", PIECES["search"])]) + " || '</TABLE>'",
    "'<B>References Cited</B>'",
    "'<TABLE><TR><TD>U.S. Patent Documents</TD></TR>' || " + " || ".join(map(_cells, _US)) + " || '</TABLE><TABLE><TR><TD>Foreign Patent Documents</TD></TR>' || " + " || ".join(map(_cells, _FOREIGN)) + " || '</TABLE><TABLE>Other References<br>' || " + " || '<br>' || ".join(_OTHER) + " || '</TABLE><TABLE><TR><TD>Primary Examiner: Nobody</TD></TR><TR><TD>after</TD></TR></TABLE>'",
    "'<B>Claims</B>'", f"({CLAIMS})", "'<B>Description</B>'", f"({DESCRIPTION})",
])
_DIV = lambda tag, label, value: f"'<div><{tag}>{label}</{tag}> <{tag}> </{tag}><{tag}>' || {value} || '</{tag}></div>'"
NEW = " || ".join([
    f"'<html><body><span class=\"MatchFromOtherFieldStyle\">' || {PIECES['no']} || '</span>'", _DIV("span", " Date of Patent ", PIECES["long"]), f"'<h2>' || {PIECES['title']} || '</h2>'",
    _DIV("p", "Inventors:", f"'<b>' || {PIECES['inventors']} || '</b>'"), _DIV("p", "Assignee:", f"({PIECES['assignee']})"), _DIV("p", "Appl. No.:", PIECES["apply_no"]), _DIV("p", "Filed:", PIECES["long"]), _DIV("p", "U.S. Cl.:", PIECES["us_class"]), _DIV("p", "CPC", "'G06F ' || (k % 9)"), _DIV("p", "Int. Cl.:", PIECES["intern_class"]),
    f"'<h3> Abstract </h3><p>' || ({PIECES['abstract']}) || '</p><h3>Claims</h3><p>' || replace({CLAIMS}, '{BR}', '<br>') || '</p>'",
    "'<h3>Background/Summary</h3><div><p>PARENT <br>FIELD <br>The field of ' || seg || '. <br>BACKGROUND <br>It was ' || k || '. <br>SUMMARY OF IT <br>In sum &amp; short ' || k || '.</p></div>'",
    "'<h3>Description</h3><p>BRIEF DESCRIPTION OF THE DRAWINGS <br>FIG. 1. <br>DETAILED DESCRIPTION<br>In detail.</p></body></html>'",
])


def _composed(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    base = scattered(table(spark, d, "customer"), "c_custkey").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("seg"), F.col("n_name").alias("nation"))
    return base.select(*(F.expr(v).alias(c) for c, v in columns.items()))


def _old(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d, html=OLD).select("html", P.old_pages("html").alias("p")).select("html", "p.*")


def _sql(select: str) -> str:
    return f"SELECT {select} FROM {_BASE}"


_FOUND = ", ".join(f"{v} AS {c}" for c, v in {"pat_no": PIECES["no"], "issued": PIECES["slash"], "title": PIECES["title"], "abstract": PIECES["abstract"], "inventors": PIECES["inventors"], "assignee": PIECES["assignee"], "apply_no": PIECES["apply_no"], "filed": PIECES["long"], "us_class": PIECES["us_class"], "intern_class": PIECES["intern_class"], "search_field": PIECES["search"], "claims": f"replace({CLAIMS}, '   ', ' ')", "description": DESCRIPTION}.items())


@query("tx19_old_pages", _sql(_FOUND))
def old_pages(spark, d):
    return _old(spark, d).select("pat_no", "issued", "title", "abstract", "inventors", "assignee", "apply_no", "filed", "us_class", "intern_class", "search_field", "claims", "description")


@query("tx18_new_pages", _sql(f"{PIECES['no']} AS pat_no, {PIECES['slash']} AS issued, {PIECES['title']} AS title, {PIECES['inventors']} AS inventors, {PIECES['assignee']} AS assignee, {PIECES['apply_no']} AS apply_no, {PIECES['slash']} AS filed, {PIECES['us_class']} AS us_class, 'G06F ' || (k % 9) AS cpc_class, {PIECES['intern_class']} AS intern_class, {PIECES['abstract']} AS abstract, replace({CLAIMS}, '{BR}', '') AS claims, 'FIELD  The field of ' || seg || '.  ' AS application, 'BACKGROUND  It was ' || k || '.  ' AS task, 'SUMMARY OF IT  In sum & short ' || k || '. ' AS summary, 'BRIEF DESCRIPTION OF THE DRAWINGS  FIG. 1.  ' AS drawings"))
def new_pages(spark, d):
    p = _composed(spark, d, html=NEW).select(P.new_pages("html").alias("p"))
    return p.select(*(f"p.{f}" for f in ("pat_no", "issued", "title", "inventors", "assignee", "apply_no", "filed", "us_class", "cpc_class", "intern_class", "abstract", "claims", "application", "task", "summary", "drawings")))


@query("tx09_claims", f"WITH b AS {_BASE} SELECT k, 1 AS no, true AS leading, '1. A device of kind ' || k || '.' AS text FROM b UNION ALL SELECT k, 2, false, '2. The device of claim 1.{BR}with a lid' FROM b UNION ALL SELECT k, 3, true, '3. A method.' FROM b UNION ALL SELECT k, 4, false, '4. The method of Claim 3.' FROM b WHERE k % 2 = 0")
def claims(spark, d):
    return _composed(spark, d, k="k", text=CLAIMS).select("k", F.inline(P.claims(F.col("text"))))


@query("ag13_item_counts", _sql("k, 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS items, 2 AS leads, CASE k % 3 WHEN 0 THEN 6 ELSE 5 END AS sections"))
def item_counts(spark, d):
    p = _composed(spark, d, k="k", text=CLAIMS, description=DESCRIPTION).withColumn("c", P.claims(F.col("text")))
    return p.select("k", F.size("c").alias("items"), F.size(F.filter("c", lambda x: x["leading"])).alias("leads"), F.size(P.contents(F.col("description"))).alias("sections"))


_TOC = [("FIELD OF THE INVENTION", "'The field of ' || seg || '.'", "k % 3 = 0"), ("BACKGROUND", f"'It was so ' || k || '.{BR}More of it.'", "k % 3 = 0"), ("BACKGROUND OF THE INVENTION", f"'1. Field of it{BR}A field of ' || seg || '.{BR}2. Related Art{BR}Prior of ' || k || '.{BR}And more.'", "k % 3 = 1"), ("BACKGROUND", f"'First of ' || k || '.{BR}Second.{BR}Third.'", "k % 3 = 2"), ("SUMMARY", "'In sum ' || k || '.'", "true"), ("BRIEF DESCRIPTION OF THE DRAWINGS", "'FIG. 1 shows it.'", "true"), ("SUMMARY OF DESCRIPTION", "'Overwritten.'", "true"), ("DETAILED DESCRIPTION", f"'In detail ' || k || '.{BR}Again.{BR}* * * * *'", "true")]


@query("tx10_contents", f"WITH b AS {_BASE} " + " UNION ALL ".join(f"SELECT k, '{t}' AS title, {body} AS body FROM b WHERE {when}" for t, body, when in _TOC))
def contents(spark, d):
    return _composed(spark, d, k="k", description=DESCRIPTION).select("k", F.inline(P.contents(F.col("description")))).select("k", "title", F.array_join("body", BR).alias("body"))


_SECTIONS = {"application": "CASE k % 3 WHEN 0 THEN 'The field of ' || seg || '.' WHEN 1 THEN 'A field of ' || seg || '.' ELSE 'First of ' || k || '.' END", "task": f"CASE k % 3 WHEN 0 THEN 'It was so ' || k || '.{BR}More of it.' WHEN 1 THEN 'Prior of ' || k || '.{BR}And more.' ELSE 'Second.{BR}Third.' END", "summary": "'In sum ' || k || '.'", "drawings": "'FIG. 1 shows it.'", "features": f"'In detail ' || k || '.{BR}Again.'"}


@query("tx12_sections", _sql(f"{PIECES['no']} AS pat_no, " + ", ".join(f"{v} AS {c}" for c, v in _SECTIONS.items()) + ", CASE k % 3 WHEN 1 THEN '2. Related Art' ELSE 'BACKGROUND' END AS task_title"))
def sections(spark, d):
    return R.with_sections(_old(spark, d)).select("pat_no", *_SECTIONS, "task_title")


@query("tx11_headlines", f"WITH b AS {_BASE} " + " UNION ALL ".join(f"SELECT k, '{t}' AS line FROM b WHERE {when}" for t, _, when in [*_TOC, ("1. Field of it", "", "k % 3 = 1"), ("2. Related Art", "", "k % 3 = 1")]))
def headlines(spark, d):
    lines = _composed(spark, d, k="k", description=DESCRIPTION).select("k", F.explode(P.paragraphs(F.col("description"))).alias("line"))
    return lines.filter(P.is_headline(F.col("line")))


TASK = f"CASE k % 3 WHEN 1 THEN '[0003] 1. Field of it{BR}A field of ' || seg || '.{BR}2. Related Art{BR}Prior of ' || k || '.{BR}And more.' ELSE 'First of ' || k || '.{BR}Second.{BR}Third.' END"


@query("tx16_background", f"SELECT k, {_SECTIONS['application']} AS application, {_SECTIONS['task']} AS task FROM {_BASE} WHERE k % 3 > 0")
def background(spark, d):
    p = _composed(spark, d, k="k", task=TASK).filter("k % 3 > 0")
    return p.select("k", P.background(P.paragraphs(F.col("task"))).alias("b")).select("k", F.array_join("b.application", BR).alias("application"), F.array_join("b.task", BR).alias("task"))


@query("tx14_citation_router", f"WITH b AS {_BASE} " + " UNION ALL ".join(f"SELECT {PIECES['no']} AS pat_no, '{kind}' AS kind, {c} AS cite FROM b" for kind, cs in (("us", _US), ("foreign", _FOREIGN), ("other", _OTHER)) for c in cs))
def citation_router(spark, d):
    p = _old(spark, d).select("pat_no", P.routed(F.col("cites")).alias("r"))
    return p.select("pat_no", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("us", "foreign", "other"))), F.array("r.us", "r.foreign", "r.other"))).alias("kind", "c")).select("pat_no", "kind", F.explode("c").alias("cite"))


@query("sk12_cited_patents", f"WITH b AS {_BASE} SELECT {PIECES['no']} AS patent_no, '' || (4000000 + k) AS cited_no, '1978/10/01' AS date, 'Doe' || k AS inventor, (k % 9) || '/45' AS class, 'US' AS country FROM b UNION ALL SELECT {PIECES['no']}, '' || (4100000 + k), '1990/01/01', 'Roe', '7/8', 'US' FROM b UNION ALL SELECT {PIECES['no']}, 'EP' || k, '1991/05/01', '', 'X/1', 'EP' FROM b")
def cited_patents(spark, d):
    return R.cited_patents(_old(spark, d))


@query("sk13_cited_papers", _sql(f"{PIECES['no']} AS patent_no, 1 AS type, '1988/01/01' AS year, '' || (k % 30 + 1) AS vol, '' || (k % 400 + 1) AS page, 'Smith, J.' AS author, 'On widgets of ' || seg AS title, 'Journal of Widgets' AS journal, {_OTHER[0]} AS citation"))
def cited_papers(spark, d):
    return R.cited_papers(_old(spark, d)).drop("id")


_OWNERS = f"""WITH b AS {_BASE} SELECT {PIECES['no']} AS patent_no, 'Inventors' AS owner_type, 0 AS place, 'Lee' || k || ', Ann' AS name, 'Dallas' AS city, {_STATE} AS state, 'US' AS country, 1 AS kind FROM b
UNION ALL SELECT {PIECES['no']}, 'Inventors', 1, 'Kim, Bo', 'City' || k % 7, NULL, nation, 1 FROM b
UNION ALL SELECT {PIECES['no']}, 'Assignee', 0, CASE k % 4 WHEN 0 THEN name || ' Ltd.' WHEN 1 THEN name || ' Inc.' WHEN 2 THEN 'Group ' || name ELSE name || ' GmbH' END, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Austin' WHEN 2 THEN 'Oslo' ELSE 'Bonn' END, CASE k % 4 WHEN 1 THEN 'TX' END, CASE k % 4 WHEN 1 THEN 'US' WHEN 3 THEN 'DE' ELSE nation END, CASE WHEN k % 4 < 2 THEN 2 ELSE 1 END FROM b"""


@query("sk11_owners", _OWNERS)
def owners(spark, d):
    return R.owners(_old(spark, d))


@query("tx13_owner_kinds", f"SELECT kind, country, count(*) AS n FROM ({_OWNERS}) WHERE owner_type = 'Assignee' GROUP BY kind, country")
def owner_kinds(spark, d):
    rows = _composed(spark, d, assignee=PIECES["assignee"], raw=PIECES["bold"]).select(F.explode(T.owners(F.col("assignee"), F.col("raw"))).alias("o"))
    return rows.groupBy("o.kind", "o.country").agg(F.count("*").alias("n"))


@query("sk10_classes", f"WITH b AS {_BASE} SELECT {PIECES['no']} AS patent_no, 'Current U.S. Class' AS class_type, (k % 5) || '/' || (k % 11) AS class, true AS is_main FROM b UNION ALL SELECT {PIECES['no']}, 'Current U.S. Class', (k % 7) || '/9', false FROM b UNION ALL SELECT {PIECES['no']}, 'Current CPC Class', 'G06F ' || (k % 9), true FROM b UNION ALL SELECT {PIECES['no']}, 'Current CPC Class', 'H04L 1/' || k, false FROM b UNION ALL SELECT {PIECES['no']}, 'Intern Class', {PIECES['intern_class']}, true FROM b")
def classes(spark, d):
    p = _old(spark, d).withColumn("k", F.col("pat_no").cast("int") - 7000000)
    return R.class_items(p.withColumn("cpc_class", F.expr("' ; G06F ' || (k % 9) || '&nbsp(20060101);; H04L 1/' || k || '&nbsp()'").substr(2, 99)))


@query("sk08_patent_info", _sql(f"{PIECES['no']} AS patent_no, 'US' AS country, make_date((1995 + k % 10)::BIGINT, (k % 12 + 1)::BIGINT, (1 + k % 28)::BIGINT)::VARCHAR AS issued, {PIECES['title']} AS title, {PIECES['apply_no']} AS apply_no, make_date((1995 + k % 10)::BIGINT, (k % 12 + 1)::BIGINT, (1 + k % 28)::BIGINT)::VARCHAR AS apply_date, {PIECES['search']} AS search_field"))
def patent_info(spark, d):
    return R.infos(_old(spark, d)).drop("family_id").withColumns({c: F.col(c).cast("string") for c in ("issued", "apply_date")})


_TITLES = {"application": "CASE k % 3 WHEN 0 THEN 'FIELD OF THE INVENTION' WHEN 1 THEN '1. Field of it' ELSE 'application' END", "task": "CASE k % 3 WHEN 1 THEN '2. Related Art' ELSE 'BACKGROUND' END", "summary": "'SUMMARY'", "drawings": "'BRIEF DESCRIPTION OF THE DRAWINGS'", "features": "'DETAILED DESCRIPTION'"}
_TEXTS = _SECTIONS | {"abstract": PIECES["abstract"], "claims": f"replace({CLAIMS}, '   ', ' ')", "topics": "NULL::VARCHAR"}


@query("sk09_descriptions", f"WITH b AS {_BASE} " + " UNION ALL ".join(f"SELECT {PIECES['no']} AS patent_no, {i} AS sequence, '{f}' AS type, {_TITLES.get(f) or repr(f)} AS title, {_TEXTS[f]} AS text FROM b" for i, f in enumerate(R.DESCRIPTIONS)))
def descriptions(spark, d):
    return R.descriptions(R.with_sections(_old(spark, d))).drop("summary")


def _store(spark: SparkSession, d: str, runs: int = 2) -> str:
    """The store of all pages, saved more than once: what is there is left alone."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    p, path = written(R.with_sections(_old(spark, d)))
    for i in range(runs):
        part = p.filter("cast(pat_no as bigint) % 2 = 0") if i == 0 else p
        R.save(R.tables(part, None, "pages", "http://localhost/$patnum"), folder)
    deleted(spark, path)
    return folder


@query("sk06_store", f"WITH b AS (SELECT count(*) AS n FROM {_BASE}) SELECT unnest(['full_text', 'info', 'description', 'class', 'owner', 'cite_patent', 'cite_paper']) AS name, unnest([n, n, 8 * n, 3 * n, 3 * n, 3 * n, n]) AS n, n AS patents FROM b")
def store(spark, d):
    """Rows and patents of each table after half of the pages and then all were saved."""
    folder, found = _store(spark, d), None
    for name in ("full_text", "info", "description", "class", "owner", "cite_patent", "cite_paper"):
        one = R.stored(spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("patent_no").alias("patents"))
        found = one if found is None else found.unionByName(one)
    return found


@query("jn04_type_dim", f"WITH o AS ({_OWNERS}), t AS (SELECT unnest({list(R.DESCRIPTIONS)}) AS type) SELECT 'type' AS dimension, type AS name FROM t UNION ALL SELECT DISTINCT 'country', country FROM (SELECT country FROM o UNION ALL SELECT 'US' UNION ALL SELECT 'EP')")
def dimensions(spark, d):
    """Names in the dimensions; each has one number, and those of the first save keep theirs."""
    folder = _store(spark, d)
    both = None
    for name in ("type", "country"):
        one = R.stored(spark, folder, name).groupBy(name, f"{name}_no").count().filter("count = 1").select(F.lit(name).alias("dimension"), F.col(name).alias("name"))
        both = one if both is None else both.unionByName(one)
    return both


@query("sk07_update", _sql(f"{PIECES['no']} AS patent_no, CASE WHEN k % 5 = 0 THEN 'new' ELSE 'http://localhost/' || {PIECES['no']} END AS url"))
def update(spark, d):
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    p, path = written(_old(spark, d).select("pat_no", "html"))
    R.save({"full_text": R.full_texts(p, "pages", "http://localhost/$patnum")}, folder)
    again = p.filter("cast(pat_no as bigint) % 5 = 0").unionByName(p.limit(1).withColumn("pat_no", F.lit("none")))
    R.save({"full_text": R.full_texts(again, "pages", "new")}, folder, update=True)
    deleted(spark, path)
    return R.stored(spark, folder, "full_text").select("patent_no", "url")


_WOS = f"""{PIECES['no']} AS patent_no, 'PT J' || chr(10) || 'AU ' || CASE k % 4 WHEN 0 THEN name || ' Ltd.' WHEN 1 THEN name || ' Inc.' WHEN 2 THEN 'Group ' || name ELSE name || ' GmbH' END || chr(10) || 'AF Lee' || k || ', Ann' || chr(10) || '   Kim, Bo' || chr(10) || 'TI ' || {PIECES['title']} || chr(10) || 'SO ' || {PIECES['intern_class']} || chr(10) || 'DE ' || chr(10) || 'ID ' || chr(10) || 'AB ' || chr(10) || 'C1 ' ||
 CASE k % 4 WHEN 0 THEN name || ' Ltd., , Null, ' || nation WHEN 1 THEN name || ' Inc., TX, Austin, US' WHEN 2 THEN 'Group ' || name || ', , Oslo, ' || nation ELSE name || ' GmbH, , Bonn, DE' END || chr(10) || 'CR Doe' || k || ', 1978, ' || (4000000 + k) || chr(10) || '   Roe, 1990, ' || (4100000 + k) || chr(10) || '   EP, 1991, EP' || k || chr(10) || '   Smith, J., 1988, Journal of Widgets, ' || (k % 30 + 1) || ', ' || (k % 400 + 1) || chr(10) || 'NR 4' || chr(10) || 'TC 0' || chr(10) || 'J9 ' || chr(10) || 'PY ' || (1995 + k % 10) || chr(10) || 'VL 0' || chr(10) || 'BP 0' || chr(10) || 'SC ' || chr(10) || 'UT ' || {PIECES['no']} || chr(10) || 'ER' || chr(10) AS record"""


@query("sk04_wos_records", _sql(_WOS))
def wos_records(spark, d):
    return R.wos_record(_old(spark, d))


@query("tx38_claims_page", _sql(f"k, '<p><b>1. A device of kind ' || k || '.</b></p>' || chr(10) || '<p>2. The device of claim 1.{BR}with a lid</p>' || chr(10) || '<p><b>3. A method.</b></p>' || CASE WHEN k % 2 = 0 THEN chr(10) || '<p>4. The method of Claim 3.</p>' ELSE '' END AS page"))
def claims_page(spark, d):
    return _composed(spark, d, k="k", text=CLAIMS).select("k", R.claims_page(P.claims(F.col("text"))).alias("page"))


@query("sk01_record_pages", _sql(f"{PIECES['no']} AS patent_no, '<b>title</b>: ' || {PIECES['title']} AS title_block, 21 AS blocks"))
def record_pages(spark, d):
    p = R.records(_old(spark, d)).withColumn("b", F.split("html", "\n<HR>\n"))
    return p.select("patent_no", F.get("b", F.lit(2)).alias("title_block"), F.size("b").alias("blocks"))


@query("sc10_saved_directory", _sql(f"{PIECES['no']} AS patent_no, true AS complete, {PIECES['title']} AS title"))
def saved_directory(spark, d):
    """Pages saved one a file, read from their folder and parsed."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    O.write_pages(_composed(spark, d, html=OLD), folder)
    p = I.pages(spark, folder, names="part-*", end="\n").select("complete", P.old_pages("html").alias("p"))
    return p.select(F.col("p.pat_no").alias("patent_no"), "complete", "p.title")


@query("sk02_summary_pages", _sql(f"{PIECES['no']} AS patent_no, '<h3>abstract</h3>' || chr(10) || {PIECES['abstract']} || chr(10) || '<HR>' || chr(10) || '<h3>claims</h3>' || chr(10) AS html"))
def summary_pages(spark, d):
    t = R.descriptions(_old(spark, d)).filter("type in ('abstract', 'claims')")
    return R.summary_pages(t.withColumn("summary", F.when(F.col("type") == "abstract", F.col("text"))))


@query("tx44_citations", f"WITH b AS {_BASE} SELECT {PIECES['no']} AS patent_no, 'us' AS kind, 'Doe' || k || ', 1978, ' || (4000000 + k) AS citation FROM b UNION ALL SELECT {PIECES['no']}, 'us', 'Roe, 1990, ' || (4100000 + k) FROM b UNION ALL SELECT {PIECES['no']}, 'foreign', 'EP, 1991, EP' || k FROM b UNION ALL SELECT {PIECES['no']}, 'other', 'Smith, J., 1988, Journal of Widgets, ' || (k % 30 + 1) || ', ' || (k % 400 + 1) FROM b")
def citations(spark, d):
    p = _old(spark, d).select(F.col("pat_no").alias("patent_no"), P.routed(F.col("cites")).alias("r"))
    parse = {"us": P.cited_patent, "foreign": P.cited_patent, "other": P.paper_reference}

    def listed(kind: str):
        return F.transform(F.col(f"r.{kind}"), lambda c: F.struct(F.lit(kind).alias("kind"), P.cited(kind, parse[kind](c)).alias("citation")))

    return p.select("patent_no", F.inline(F.concat(*map(listed, parse))))
