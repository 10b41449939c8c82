"""Queries on text functions, document clusters, maps and the graph of senses."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.functions import text as T
from inkwarp.operators import clusters as C
from inkwarp.operators import counting as K
from inkwarp.operators import networks as N
from inkwarp.operators import senses as G
from inkwarp.operators import store as R
from inkwarp.operators import summaries as S
from inkwarp.plans.queries import _KEYS, _STOP
from inkwarp.plans.registry import query
from inkwarp.session import scattered, settle, shared_folder, spread, table
from inkwarp.sources import writers as O


def _of(spark, d, name, **columns):
    return table(spark, d, name).select(*(F.expr(v).alias(c) for c, v in columns.items()))


@query("tx01_formatted_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '9999/01/01' WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) || '/01/01' WHEN o_orderkey % 5 = 2 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/01' ELSE year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) END AS date FROM orders")
def formatted_dates(spark, d):
    part = lambda f, least: F.when(F.col("o_orderkey") % 5 >= least, f("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", T.slash_date(part(F.year, 1), part(F.month, 2), part(F.dayofmonth, 3)).alias("date"))


@query("tx06_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' || year(o_orderdate) ELSE 'in 1999' END AS year FROM orders")
def years(spark, d):
    return _of(spark, d, "orders", o_orderkey="o_orderkey", t="CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'in 1999' END").select("o_orderkey", T.year(F.col("t")).alias("year"))


@query("tx22_copyright", "SELECT p_partkey, 'On ' || p_name || '.' AS text FROM part")
def copyright_lines(spark, d):
    t = _of(spark, d, "part", p_partkey="p_partkey", t="'On ' || p_name || '. (C) ' || (1990 + p_size) || ' ELSEVIER Ltd. All rights reserved.'")
    return t.select("p_partkey", T.without_copyright(F.col("t")).alias("text"))


@query("tx29_lists", "SELECT p_partkey, replace(p_name, ' ', chr(10) || '   ') AS lines FROM part")
def lists(spark, d):
    return table(spark, d, "part").select("p_partkey", T.lines(F.replace("p_name", F.lit(" "), F.lit("; "))).alias("lines"))


@query("tx32_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_size ELSE p_size / 100 END::DOUBLE AS number FROM part")
def numbers(spark, d):
    t = _of(spark, d, "part", p_partkey="p_partkey", t="CASE WHEN p_partkey % 2 = 0 THEN '1.' || lpad('' || p_size, 3, '0') ELSE '0,' || lpad('' || p_size, 2, '0') END")
    return t.select("p_partkey", T.number(F.col("t")).alias("number"))


@query("tx33_path_buckets", "SELECT right('' || (5000000 + c_custkey), 2) AS bucket, count(*) AS n FROM customer GROUP BY 1")
def path_buckets(spark, d):
    return _of(spark, d, "customer", no="'' || (5000000 + c_custkey)").groupBy(T.bucket(F.col("no")).alias("bucket")).agg(F.count("*").alias("n"))


@query("tx34_quotes", "SELECT p_partkey, p_brand || '''''s ' || p_name AS quoted FROM part")
def quotes(spark, d):
    return table(spark, d, "part").select("p_partkey", T.doubled(F.concat("p_brand", F.lit("'s "), "p_name")).alias("quoted"))


@query("tx35_forms", "SELECT p_partkey, p_name AS name, p_brand || chr(0) || p_size AS both FROM part")
def forms(spark, d):
    form = F.concat(F.lit("name="), F.url_encode("p_name"), F.lit("&x="), F.url_encode("p_brand"), F.lit("&empty&x="), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.decoded(form).alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["x"].alias("both"))


@query("tx36_colours", "SELECT k, (255 - floor(least(255.0, c * (255 - b * 255) + b * 255) + 0.5))::INT AS r, (255 - floor(least(255.0, m * (255 - b * 255) + b * 255) + 0.5))::INT AS g, (255 - floor(least(255.0, y * (255 - b * 255) + b * 255) + 0.5))::INT AS b FROM (SELECT p_partkey AS k, (p_size % 11) / 10 AS c, (p_partkey % 5) / 4 AS m, (p_size % 5) / 4 AS y, (p_partkey % 9) / 8 AS b FROM part)")
def colours(spark, d):
    t = _of(spark, d, "part", k="p_partkey", c="(p_size % 11) / 10", m="(p_partkey % 5) / 4", y="(p_size % 5) / 4", b="(p_partkey % 9) / 8")
    return t.select("k", T.rgb(*(F.col(x).cast("double") for x in "cmyb")).alias("v")).select("k", "v.*")


@query("tx39_rounded", "SELECT s_suppkey, printf('%.3f', s_acctbal / 7) AS value FROM supplier")
def rounded(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.fixed(F.col("s_acctbal") / 7, 3).alias("value"))


@query("tx42_capitals", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part")
def capitals(spark, d):
    return table(spark, d, "part").select("p_partkey", T.capitalised(F.col("p_name")).alias("name"))


@query("tx23_occurrences", "SELECT doc_id, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS n FROM documents")
def occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("The")).cast("bigint").alias("n"))


@query("jn12_states", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'TX' WHEN c_custkey % 4 = 1 THEN 'PR' END AS state, CASE WHEN c_custkey % 4 < 2 THEN 'US' ELSE n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def states(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    owner = F.concat("c_name", F.lit(" (Town, "), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'TX' WHEN c_custkey % 4 = 1 THEN 'PR' ELSE n_name END"), F.lit(")"))
    return c.select("c_custkey", T.owners(owner)[0].alias("o")).select("c_custkey", "o.state", "o.country")


@query("jn13_fields_of_categories", "SELECT p_type AS category, p_type || '/' || length(p_type) AS field, count(*) AS n FROM part GROUP BY p_type")
def fields_of_categories(spark, d):
    """A map of categories to fields, joined to what has categories."""
    t = table(spark, d, "part").select(F.col("p_type").alias("category"))
    fields = t.distinct().select("category", F.concat("category", F.lit("/"), F.length("category").cast("string")).alias("field"))
    return K.mapped(t, fields, "category").groupBy("category", "field").agg(F.count("*").alias("n"))


@query("ag04_citation_types", "SELECT p_partkey % 3 AS type, count(*) AS n FROM part GROUP BY 1")
def citation_types(spark, d):
    cite = "'Roe, A., \"On it,\" J. of X, ' || CASE p_partkey % 3 WHEN 1 THEN 'vol. 3, p. 5, 1990.' WHEN 2 THEN '1990.' ELSE 'n.d.' END"
    rows = _of(spark, d, "part", c=cite).select(P.paper_reference(F.col("c"))["type"].cast("bigint").alias("type"))
    return rows.groupBy("type").agg(F.count("*").alias("n"))


@query("so05_inverted", "SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def inverted(spark, d):
    return G.inverted(table(spark, d, "part"), "p_partkey", "p_name")


@query("tx37_highlights", "SELECT p_partkey, '<mark>The <b>' || split_part(p_name, ' ', 1) || '</b> one.</mark>|Not <b>' || upper(split_part(p_name, ' ', 1)) || '</b>.' AS page FROM part")
def highlights(spark, d):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    text = F.array(F.concat(F.lit("The "), word, F.lit(" one.")), F.concat(F.lit("Not "), F.upper(word), F.lit(".")))
    return table(spark, d, "part").select("p_partkey", F.array_join(R.highlighted(text, F.slice(text, 1, 1), F.array(word)), "|").alias("page"))


_CASE = "CASE c_custkey % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'abstract' ELSE 'features' END"


@query("tx26_section_summaries")
def section_summaries(spark, d):
    """The best sentence of three kinds of sections; clue words count in tasks and features."""
    paras = F.array(F.concat(F.lit("The "), "c_name", F.lit(" engine drives the large engine rotor.")), F.lit("FIG. 1 shows it in all its detail here."), F.lit("The cost problem of the engine is an important issue here."), F.lit("and so it is with all the rest of them."))
    rows = scattered(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.expr(_CASE).alias("section"), F.concat(F.lit("engine engine "), F.lower(F.lit("rotor"))).alias("title"), paras.alias("paras"))
    return S.section_summaries(rows, 6, {"task": 1, "abstract": 1, "features": 1}).select("doc_id", "section", F.col("summary")[0].alias("summary"))


_TFIDF = f"""o AS (SELECT k.doc_id, k.term, c.tf FROM {_KEYS} k JOIN (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) GROUP BY ALL) c USING (doc_id, term)),
nn AS (SELECT count(DISTINCT doc_id) AS n FROM o), df AS (SELECT term, count(*) AS df FROM o GROUP BY term), w AS (SELECT doc_id, term, tf * ln(n / df) AS w FROM o JOIN df USING (term), nn WHERE df < n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), v AS (SELECT doc_id, term, w / norm AS w FROM w JOIN l USING (doc_id)),
sims AS (SELECT a.doc_id AS i, b.doc_id AS j, round(sum(a.w * b.w), 4) AS sim FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)"""


def _index(spark, d):
    """Postings of the key terms that are single words."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return settle(S.topics(docs).filter("term not like '% %'").select("doc_id", "term", "tf"))


@query("cl02_document_similarity", f"WITH {_TFIDF} SELECT i AS a, j AS b, sim FROM sims WHERE sim >= 0.3")
def document_similarity(spark, d):
    return N.similar(_index(spark, d), 0.3)


_TERMS = _TFIDF.split("nn AS")[0] + "nn AS (SELECT count(DISTINCT term) AS n FROM o), df AS (SELECT doc_id, count(*) AS df FROM o GROUP BY doc_id), w AS (SELECT doc_id, term, tf * ln(n / df) AS w FROM o JOIN df USING (doc_id), nn WHERE df < n), l AS (SELECT term, sqrt(sum(w * w)) AS norm FROM w GROUP BY term), v AS (SELECT doc_id, term, w / norm AS w FROM w JOIN l USING (term))"


@query("cl06_term_similarity", f"WITH {_TERMS} SELECT a.term AS a, b.term AS b, round(sum(a.w * b.w), 4) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL HAVING round(sum(a.w * b.w), 4) >= 0.6")
def term_similarity(spark, d):
    return N.similar(_index(spark, d), 0.6, item="term", by="doc_id")


@query("cl01_document_index", f"WITH {_TFIDF.split('sims AS')[0].rstrip(', ' + chr(10))} SELECT doc_id, term, tf FROM o JOIN df USING (term) WHERE df BETWEEN 2 AND 30000 AND tf >= 2")
def document_index(spark, d):
    p = _index(spark, d)
    df = K.document_frequency(p)
    return p.join(df.select("term"), "term", "left_semi").filter("tf >= 2").select("doc_id", "term", "tf")


@query("cl05_document_clusters")
def document_clusters(spark, d):
    """Clusters of documents made in stages, then cut anew from the saved tree."""
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    p = _index(spark, d)
    C.cluster_documents(p, folder, 0.2)
    return C.cluster_documents(p, folder, 0.2, tree_cut=0.4)


@query("sk21_cluster_folders")
def cluster_folders(spark, d):
    found = document_clusters(spark, d)
    return O.folders(found.select(F.col("doc_id").alias("node"), "cluster"), found.select("cluster", "title").distinct())


_FIVE = [(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.5), (0, 4, 0.5), (1, 2, 0.2929), (1, 3, 0.2929), (1, 4, 0.0), (2, 3, 0.0), (2, 4, 0.2929), (3, 4, 0.2929)]


@query("cl12_topic_map", "SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([0.5, 0.5, 0.0, 0.0, 0.0]) AS eigenvalue, 1.0 AS r")
def topic_map(spark, d):
    """The map of five topics, a centre and the corners of a square, from their similarities: eigenvalues, and the correlation of distances."""
    pairs = spark.createDataFrame([(i, j, s, 1) for i, j, s in _FIVE], "i int, j int, sim double, map int")

    def run(t):
        m = np.zeros((5, 5))
        m[t["i"], t["j"]] = m[t["j"], t["i"]] = 1 - t["sim"]
        points, values = C.classical_mds(m, 2)
        return pd.DataFrame({"k": range(1, 6), "eigenvalue": np.abs(np.round(values, 3)), "r": round(C.map_quality(m, points), 3)})

    return pairs.groupBy("map").applyInPandas(run, "k int, eigenvalue double, r double")


@query("cl09_maps_keep_order")
def maps_keep_order(spark, d):
    """Stress of a metric and a non-metric map of the mean vectors of labels, before and after."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).withColumn("map", F.lit(1))

    def run(t):
        x = t.pivot(index="label", columns="i", values="v").to_numpy()
        m = np.linalg.norm(x[:, None] - x[None], axis=2)
        first = C.classical_mds(m, 2)[0]
        return pd.DataFrame({"method": ["sammon", "kruskal"], "before": [C.sammon(m, first, rounds=0)[1], C.kruskal(m, first, rounds=1)[1]], "after": [C.sammon(m, first)[1], C.kruskal(m, first)[1]]})

    return rows.groupBy("map").applyInPandas(run, "method string, before double, after double")


def _senses(spark, d):
    """Customers are words of senses below nations, these below regions; a customer in ten is known by a form only."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    sense = c.filter("c_custkey % 10 > 0").select(F.lower("c_name").alias("word"), F.lit("n").alias("pos"), F.lit(1).alias("sense_no"), F.expr("'n' || c_nationkey").alias("synset"))
    form = c.filter("c_custkey % 10 = 0").select(F.lower("c_name").alias("word"), F.lit("n").alias("pos"), F.expr("lower(left(c_name, length(c_name) - 1)) || '1'").alias("base"))
    up = n.select(F.expr("'n' || n_nationkey").alias("src"), F.lit("@").alias("ptr"), F.expr("'r' || n_regionkey").alias("dst")).union(table(spark, d, "region").select(F.expr("'r' || r_regionkey"), F.lit("@"), F.lit("top")))
    return sense, form, up.union(up.select("dst", F.lit("~"), "src")).union(n.select(F.expr("'n' || n_nationkey"), F.lit("%p"), F.expr("'m' || (n_nationkey % 4)")))


@query("gr01_lookup", "SELECT lower(a.c_name) AS word, 'n' || coalesce(b.c_nationkey, a.c_nationkey) AS synset FROM customer a LEFT JOIN customer b ON a.c_custkey % 10 = 0 AND b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 10 > 0 OR b.c_custkey IS NOT NULL")
def lookup(spark, d):
    sense, form, _ = _senses(spark, d)
    return G.lookup(table(spark, d, "customer").select(F.lower("c_name").alias("word"), F.lit("n").alias("pos")), sense, form).select("word", "synset")


@query("gr02_forms", "SELECT lower(left(c_name, length(c_name) - 1)) || '1' AS base, lower(c_name) AS words FROM customer WHERE c_custkey % 10 = 0")
def word_forms(spark, d):
    return G.reverse_forms(_senses(spark, d)[1]).select("base", "words")


@query("gr02_familiarity", "SELECT 'n' || c_nationkey AS word, count(*) AS n FROM customer WHERE c_custkey % 10 > 0 GROUP BY 1")
def familiarity(spark, d):
    return G.familiarity(_senses(spark, d)[0].select(F.col("synset").alias("word"), "pos")).select("word", "n")


@query("gr02_beginning", "SELECT lower(c_name) AS word FROM customer WHERE c_custkey % 10 > 0 AND lower(c_name) LIKE 'customer#00000001%'")
def beginning(spark, d):
    return G.beginning(_senses(spark, d)[0], "Customer#00000001")


_UP = "u AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'top' FROM region)"


@query("gr03_pointers", f"WITH {_UP} SELECT '@' AS kind, src, dst FROM u WHERE src <> 'n1' UNION ALL SELECT '~', dst, src FROM u UNION ALL SELECT '%', 'n' || n_nationkey, 'm' || (n_nationkey % 4) FROM nation UNION ALL SELECT '!', 'r0', 'r1'")
def pointers(spark, d):
    """Pointers of three kinds after one was added and one taken away."""
    p = _senses(spark, d)[2]
    p = G.without_pointers(G.with_pointers(p, spark.createDataFrame([("r0", "!", "r1"), ("r0", "!", "r1")], "src string, ptr string, dst string")), p.filter("src = 'n1' and ptr = '@'"))
    found = None
    for k in ("@", "~", "%", "!"):
        one = G.pointed(p, k).select(F.lit(k).alias("kind"), "src", "dst")
        found = one if found is None else found.unionByName(one)
    return found


@query("gr05_traverse", f"WITH {_UP} SELECT src AS node, dst AS ancestor, 1 AS depth FROM u UNION ALL SELECT a.src, b.dst, 2 FROM u a JOIN u b ON a.dst = b.src")
def traverse(spark, d):
    return G.traverse(_senses(spark, d)[2], "@")


@query("gr05_coordinates", f"WITH {_UP} SELECT a.src AS synset, b.src AS coordinate FROM u a JOIN u b ON a.dst = b.dst")
def coordinates(spark, d):
    return G.coordinates(_senses(spark, d)[2])


@query("gr05_before", f"WITH {_UP} SELECT dst AS synset, src AS before FROM u WHERE dst = 'top'")
def before(spark, d):
    p = _senses(spark, d)[2]
    return G.before(p, "@", spark.createDataFrame([("top",)], "synset string"), p.filter("src like 'n%' and ptr = '@'").select(F.col("src").alias("synset")))


@query("gr06_distance", f"WITH {_UP} SELECT src AS a, 'top' AS b, CASE WHEN src LIKE 'n%' THEN 2 ELSE 1 END AS distance FROM u UNION ALL SELECT src, 'nowhere', 0 FROM u")
def distance(spark, d):
    p = _senses(spark, d)[2]
    a = p.filter("ptr = '@'").select(F.col("src").alias("a"))
    return G.distance(p, "@", a.withColumn("b", F.explode(F.array(F.lit("top"), F.lit("nowhere")))))


@query("gr06_global_distance", "WITH x AS (SELECT min('n' || n_nationkey) FILTER (n_regionkey = 0) AS a, min('n' || n_nationkey) FILTER (n_regionkey = 1) AS b FROM nation) SELECT 4 AS distance, b || ' : r1|hyper : top|hyper : r0|hypo : ' || a || '|hypo' AS path FROM x")
def global_distance(spark, d):
    p, n = _senses(spark, d)[2], table(spark, d, "nation")
    p = p.filter("ptr <> '%p'")
    one = lambda r: n.filter(F.col("n_regionkey") == r).agg(F.min(F.expr("'n' || n_nationkey")).alias("synset"))
    return G.global_distance(p, one(0), one(1), 10)


@query("gr07_surroundings", f"WITH {_UP} SELECT src, dst, 'hyper' AS kind FROM u UNION ALL SELECT dst, src, 'hypo' FROM u UNION ALL SELECT 'n' || n_nationkey, 'm' || (n_nationkey % 4), 'mero' FROM nation")
def surroundings(spark, d):
    return G.surroundings(_senses(spark, d)[2])


@query("so04_sense_sets", "WITH s AS (SELECT DISTINCT c_mktsegment AS s, 'n' || c_nationkey AS synset FROM customer) SELECT 'union' AS op, synset FROM (SELECT DISTINCT synset FROM s) UNION ALL SELECT 'intersection', synset FROM s GROUP BY synset HAVING count(*) = (SELECT count(DISTINCT s) FROM s)")
def sense_sets(spark, d):
    sets = table(spark, d, "customer").select(F.col("c_mktsegment").alias("set"), F.expr("'n' || c_nationkey").alias("synset"))
    return G.union(sets).select(F.lit("union").alias("op"), "synset").unionByName(G.intersection(sets).select(F.lit("intersection").alias("op"), "synset"))


@query("gr07_is_broader", f"WITH {_UP} SELECT dst AS a, src AS b, true AS is_so FROM u UNION ALL SELECT src, dst, false FROM u")
def is_broader(spark, d):
    p = _senses(spark, d)[2]
    up = p.filter("ptr = '@'")
    return G.are(p, "@", up.select(F.col("dst").alias("a"), F.col("src").alias("b")).union(up.select("src", "dst")))


@query("gr04_edited_senses", "SELECT lower(c_name) AS word, 1 AS sense_no, 'n' || c_nationkey AS synset FROM customer WHERE c_custkey % 10 > 0 AND c_nationkey <> 3 UNION ALL SELECT lower(c_name), CASE WHEN c_custkey % 10 > 0 THEN 2 ELSE 1 END, 'x' || (c_custkey % 2) FROM customer")
def edited_senses(spark, d):
    """The index after each word was given a sense, and a synset was taken away."""
    sense, _, pointer = _senses(spark, d)
    new = table(spark, d, "customer").select(F.lower("c_name").alias("word"), F.lit("n").alias("pos"), F.expr("'x' || (c_custkey % 2)").alias("synset"))
    return G.without_senses(G.with_senses(sense, new), pointer, spark.createDataFrame([("n3",)], "synset string"))[0].select("word", "sense_no", "synset")


_NETS = f"k AS (SELECT k.*, lang = 'en' AS en FROM {_KEYS} k JOIN documents USING (doc_id) WHERE lang IS NOT NULL), df AS (SELECT en, term, count(*) AS df FROM k GROUP BY ALL HAVING count(*) BETWEEN 2 AND 30000), g AS (SELECT x.en, x.term AS a, y.term AS b, printf('%.4f', round(2.0 * count(*) / (any_value(p.df) + any_value(q.df)), 4)) AS dice FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.term < y.term JOIN df p ON p.en = x.en AND p.term = x.term JOIN df q ON q.en = y.en AND q.term = y.term GROUP BY x.en, x.term, y.term)"


@query("cl18_network_comparison", f"WITH {_NETS} SELECT a, b, CASE WHEN bool_or(en) AND bool_or(NOT en) THEN 'both' WHEN bool_or(en) THEN 'left' ELSE 'right' END AS side, max(dice) FILTER (en) AS dice_1, max(dice) FILTER (NOT en) AS dice_2 FROM g GROUP BY a, b")
def network_comparison(spark, d):
    """The networks of key terms of English and other documents."""
    nets = []
    for op in ("=", "<>"):
        p = settle(S.topics(table(spark, d, "documents").filter(f"lang {op} 'en'")).select("doc_id", "term"))
        nets.append(N.dice(p, settle(K.document_frequency(p))))
    return N.comparison(*nets)


@query("tx40_today", "SELECT n_nationkey, strftime(current_date, '%Y') || '/' || month(current_date) || '/' || day(current_date) AS updated FROM nation")
def today(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.today().alias("updated"))


@query("cl16_ols_errors", "WITH s AS (SELECT count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem), e AS (SELECT *, (syy - b * b * sxx) / (n - 2) AS v FROM s) SELECT round(a + 10 * b, 2) AS value, round(sqrt(v * (1 / n + (10 - mx) * (10 - mx) / sxx)), 3) AS error, round(sqrt(v / sxx), 3) AS slope_error FROM e")
def ols_errors(spark, d):
    """The fitted price of ten pieces, a linear combination of coefficients, with its standard error."""
    r = C.regression(table(spark, d, "lineitem").withColumn("one", F.lit(1.0)), "l_extendedprice", ["one", "l_quantity"])
    value, error = C.combination(r, [1.0, 10.0])
    return spark.createDataFrame([(round(value, 2), round(error, 3), round(float(r["errors"][1]), 3))], "value double, error double, slope_error double")
