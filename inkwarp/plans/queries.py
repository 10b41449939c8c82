"""The queries on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarp.functions import text as T
from inkwarp.operators import clusters as C
from inkwarp.operators import counting as K
from inkwarp.operators import networks as N
from inkwarp.operators import summaries as S
from inkwarp.plans.registry import query
from inkwarp.session import settle, spread, table
from inkwarp.sources.writers import tagged_record

CUT = 0.3
_TOKENS = "SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents"
_POSTINGS = f"SELECT doc_id, term, count(*) AS tf FROM ({_TOKENS}) WHERE term <> '' GROUP BY ALL"
_KEYS = f"""(WITH wk AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents),
tk AS (SELECT doc_id, term, tf, 1 AS n FROM ({_POSTINGS}) WHERE length(term) >= 4 UNION ALL SELECT doc_id, array_to_string(g, ' '), count(*), 2 FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM wk WHERE len(w) >= 2) GROUP BY doc_id, g HAVING count(*) >= 2)
SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf * n DESC, term) AS place FROM tk) WHERE place <= 12)"""
_DICE = f"""o AS (SELECT * FROM {_KEYS}), v AS (SELECT term, count(*) AS df FROM o GROUP BY term HAVING count(*) BETWEEN 2 AND 30000),
n AS (SELECT a.term AS a, b.term AS b, count(*) AS df12 FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


@query("kp01_token_counts", f"SELECT term, count(*) AS n FROM ({_TOKENS}) WHERE term <> '' GROUP BY term")
def token_counts(spark, d):
    return K.tokens(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("n"))


@query("ag07_document_frequency", f"SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term HAVING count(*) BETWEEN 2 AND 30000")
def document_frequency(spark, d):
    return K.document_frequency(K.postings(_docs(spark, d)))


@query("ag08_cooccurrence_dice", f"WITH {_DICE} SELECT a, b, df12, round(2.0 * df12 / (x.df + y.df), 4)::DOUBLE AS dice FROM n JOIN v x ON x.term = a JOIN v y ON y.term = b")
def cooccurrence(spark, d):
    """The network of the documents' key terms."""
    p = settle(S.topics(_docs(spark, d)).select("doc_id", "term"))
    return N.dice(p, settle(K.document_frequency(p)))


@query("ag01_type_occurrences", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY term")
def occurrences(spark, d):
    return K.occurrences(table(spark, d, "part"), "p_name", " ")


@query("ag02_country_counts", "SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def countries(spark, d):
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("n"))


@query("jn15_bibliographic_coupling", "WITH r AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS k FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n FROM r x JOIN r y ON x.k = y.k AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2")
def coupling(spark, d):
    return N.shared(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 2)


@query("jn15_co_citation", "WITH r AS (SELECT DISTINCT l_partkey AS i, l_orderkey AS k FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n FROM r x JOIN r y ON x.k = y.k AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2")
def co_citation(spark, d):
    return N.shared(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", 2)


def _sides(spark, d):
    docs = _docs(spark, d).withColumn("en", F.col("lang") == "en").filter("en is not null")
    p = settle(K.postings(docs, "en"))
    return p.filter("en"), p.filter("not en")


_SIDES = f"p AS (SELECT q.*, lang = 'en' AS en FROM ({_POSTINGS}) q JOIN documents USING (doc_id))"


@query("jn06_node_diff", f"WITH {_SIDES} SELECT term, CASE WHEN bool_or(en) AND bool_or(NOT en) THEN 'both' WHEN bool_or(en) THEN 'left' ELSE 'right' END AS side FROM p WHERE en IS NOT NULL GROUP BY term")
def node_diff(spark, d):
    a, b = _sides(spark, d)
    return K.compared(a, b, ["term"])


_EDGES = f"t AS (SELECT k.*, lang = 'en' AS en FROM {_KEYS} k JOIN documents USING (doc_id)), " + ", ".join(f"e{k} AS (SELECT DISTINCT x.term AS a, y.term AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.term < y.term WHERE x.en = {b} AND y.en = {b})" for k, b in ((1, "true"), (2, "false")))


@query("jn07_edge_diff", f"WITH {_EDGES} SELECT a, b, CASE WHEN l AND r THEN 'both' WHEN l THEN 'left' ELSE 'right' END AS side FROM (SELECT a, b, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT *, 1 AS s FROM e1 UNION ALL SELECT *, 2 FROM e2) GROUP BY a, b)")
def edge_diff(spark, d):
    a, b = (N.shared(S.topics(_docs(spark, d).filter(f"lang {op} 'en'")), "term", "doc_id") for op in ("=", "<>"))
    return K.compared(a, b, ["a", "b"])


@query("jn05_term_merge", f"WITH {_SIDES}, l AS (SELECT term, count(*) AS n FROM p WHERE en GROUP BY term), r AS (SELECT term, count(*) AS n FROM p WHERE NOT en GROUP BY term) SELECT coalesce(l.term, r.term) AS term, coalesce(l.n, 0) AS left_df, r.n AS right_df FROM l FULL JOIN r ON l.term = r.term")
def term_merge(spark, d):
    a, b = (K.document_frequency(x, 1, 1 << 62) for x in _sides(spark, d))
    return K.merged(a, b)


@query("ag03_weighted_country", "WITH w AS (SELECT l_orderkey, n_name, round(sum(1.0::DOUBLE / (l_linenumber * l_linenumber)), 9) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) SELECT l_orderkey, string_agg(n_name, '; ' ORDER BY w DESC, n_name) AS items FROM w GROUP BY l_orderkey")
def weighted_country(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return K.weighted_order(table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")), "l_orderkey", "n_name", "l_linenumber")


_ON = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("ag05_rank_pivot", f"WITH t AS (SELECT n_name, year(o_orderdate) AS y, count(*) AS n FROM {_ON} GROUP BY ALL), top AS (SELECT n_name FROM t WHERE y = (SELECT max(y) FROM t) ORDER BY n DESC, n_name LIMIT 10) SELECT y, n_name, n FROM t WHERE n_name IN (SELECT n_name FROM top)")
def rank_pivot(spark, d):
    """The report of the ten first nations of the last year, unpivoted: its columns are the nations that the data have."""
    t = _orders_nations(spark, d).groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    wide = K.report(t, "y", "n_name", "n", "n", 10)
    return wide.unpivot("y", wide.columns[1:], "n_name", "n").filter("n is not null")


def _orders_nations(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))


@query("ag06_breakdown_sets", f"SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'n_name' END AS dimension, coalesce(o_orderstatus, o_orderpriority, n_name) AS value, count(*) AS n FROM {_ON} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (n_name)) HAVING count(*) >= 3")
def breakdown(spark, d):
    return K.breakdown(_orders_nations(spark, d), ["o_orderstatus", "o_orderpriority", "n_name"], 3)


@query("jn01_segment_view", "SELECT doc_id, source, length(text) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def segment_view(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return _docs(spark, d).join(good, "doc_id").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))


@query("jn03_country_dim", "SELECT s_suppkey, no FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT n_name, dense_rank() OVER (ORDER BY n_name) AS no FROM (SELECT DISTINCT n_name FROM nation)) USING (n_name)")
def country_dim(spark, d):
    dim = K.numbered(table(spark, d, "nation"), "n_name", "no")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(F.broadcast(dim), "n_name").select("s_suppkey", F.col("no").cast("bigint").alias("no"))


@query("pf03_dedupe_first", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, d):
    first = _docs(spark, d).select("doc_id", F.md5("text").alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return _docs(spark, d).join(first, "doc_id", "left_semi").select("doc_id", "text")


@query("so02_new_minus_old", "SELECT url FROM pages WHERE url LIKE '%example.com%' EXCEPT SELECT url FROM pages WHERE url LIKE 'https:%'")
def new_minus_old(spark, d):
    p = table(spark, d, "pages").select("url")
    return p.filter("url like '%example.com%'").subtract(p.filter("url like 'https:%'"))


@query("tx18_html_fields", r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links FROM pages""")
def html_fields(spark, d):
    html = F.col("html")
    one = lambda p: F.trim(F.regexp_extract(html, p, 1))
    return table(spark, d, "pages").select("page_id", one("<title>([^<]*)</title>").alias("title"), one("<h1>([^<]*)</h1>").alias("heading"), one('<html lang="([a-z]+)"').alias("lang"), F.regexp_count(html, F.lit("<a href=")).cast("bigint").alias("links"))


@query("tx31_strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain(F.col("html")).alias("plain"))


@query("tx21_country_rule", "SELECT c_custkey, CASE WHEN regexp_matches(w, '[0-9]') THEN 'USA' ELSE w END AS country FROM (SELECT c_custkey, upper(list_filter(string_split_regex(c_name || ', ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_custkey ELSE '' END, '[ ,]+'), lambda x: x <> '')[-1]) AS w FROM customer)")
def country_rule(spark, d):
    a = F.concat("c_name", F.lit(", "), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).otherwise(""))
    return table(spark, d, "customer").select("c_custkey", T.country(a).alias("country"))


#: What kind of section a document is taken for.
_SECTION = "CASE lang WHEN 'en' THEN 'task' WHEN 'de' THEN 'abstract' ELSE 'features' END"
_SENT = rf"""s AS (SELECT doc_id, para, i - 1 AS sent, trim(x[i]) AS sentence FROM (SELECT doc_id, para, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, j - 1 AS para, regexp_extract_all(p[j], '[^.!?]+[.!?]*') AS x FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))) WHERE trim(x[i]) <> '')"""
_WEIGHTS = rf"""g AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS para, CASE WHEN regexp_matches(q, '\.\s*$') THEN q ELSE q || ' .' END AS q FROM (SELECT doc_id, section, j, regexp_replace(p[j], '<[^<]*>', '', 'g') AS q FROM (SELECT doc_id, section, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT doc_id, {_SECTION} AS section, string_split(text, chr(10)) AS p FROM documents)) WHERE NOT regexp_matches(p[j], 'FIG|Figure') AND NOT regexp_matches(p[j], 'step\s+\d+'))),
e AS (SELECT doc_id, section, para, row_number() OVER (PARTITION BY doc_id, para ORDER BY i) - 1 AS sent, trim(x[i]) AS sentence FROM (SELECT doc_id, section, para, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, regexp_extract_all(q, '[^.!?]+[.!?]*') AS x FROM g)) WHERE trim(x[i]) <> ''),
w AS (SELECT *, (CASE WHEN sent = 0 AND section <> 'abstract' THEN 1.5 ELSE 1.0 END * CASE WHEN para <= 1 THEN 2.0 WHEN para = max(para) OVER (PARTITION BY doc_id) AND section = 'task' OR para = max(para) OVER (PARTITION BY doc_id) - 1 THEN 4.0 ELSE 1.0 END)::DOUBLE AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent) AS pos, regexp_matches(sentence, '^(\[\s\d+\s\]\s*)?[A-Z]') AND NOT regexp_matches(sentence, '\s[ie]$') AS begins FROM e),
fit AS (SELECT doc_id, para, sent, sentence, weight FROM (SELECT *, min(CASE WHEN begins AND sentence LIKE '%sub .' THEN pos END) OVER (PARTITION BY doc_id) AS sub FROM w) WHERE begins AND pos <= coalesce(sub, pos) AND length(sentence) - length(replace(sentence, ' ', '')) >= 5)"""


def _sections(spark, d):
    return _docs(spark, d).withColumn("section", F.expr(_SECTION))


def _spread(rows, column):
    """An array of structs as rows with wide integers."""
    return rows.select("doc_id", F.inline_outer(column)).filter("sentence is not null").withColumns({"para": F.col("para").cast("bigint"), "sent": F.col("sent").cast("bigint")})


@query("tx25_sentence_weights", f"WITH {_WEIGHTS} SELECT doc_id, para, sent, weight FROM w")
def sentence_weights(spark, d):
    return _spread(_sections(spark, d), S.weighted(F.split("text", "\n"), F.col("section"))).drop("sentence")


@query("pf05_fit_sentences", f"WITH {_WEIGHTS} SELECT doc_id, para, sent, sentence, weight FROM fit")
def fit_sentences(spark, d):
    return _spread(_sections(spark, d), S.fit_sentences(S.weighted(F.split("text", "\n"), F.col("section"))))


@query("pf04_good_paragraphs", f"WITH {_WEIGHTS} SELECT doc_id, para, q AS paragraph FROM g")
def good_paragraphs(spark, d):
    t = _docs(spark, d).select("doc_id", F.posexplode(S.good_paragraphs(F.split("text", "\n"))).alias("para", "paragraph"))
    return t.withColumn("para", F.col("para").cast("bigint"))


_MENTIONS = rf"""{_SENT}, k AS (SELECT s.doc_id, s.para, s.sent, q.term FROM s JOIN {_KEYS} q USING (doc_id) WHERE contains(lower(sentence), q.term)),
v AS (SELECT term, count(*) AS df FROM k GROUP BY term), n AS (SELECT a.term AS a, b.term AS b, count(*) AS df12 FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.para = b.para AND a.sent = b.sent AND a.term < b.term GROUP BY ALL)"""


@query("kp04_term_links", f"WITH {_MENTIONS}, u AS (SELECT a, b, df12 FROM n UNION ALL SELECT b, a, df12 FROM n), m AS (SELECT a AS term, b AS other, round(ln(df12 * (SELECT count(*) FROM s) / (x.df * y.df)), 4) AS mi FROM u JOIN v x ON x.term = a JOIN v y ON y.term = b), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY mi DESC, other) AS place FROM m) SELECT term, other, mi, place FROM r WHERE place <= 5")
def term_links(spark, d):
    """Key terms that sentences have together."""
    sents, keys = settle(S.sentences(_docs(spark, d))), S.topics(_docs(spark, d)).groupBy("doc_id").agg(F.collect_set("term").alias("keys"))
    p = sents.join(keys, "doc_id").select(F.struct("doc_id", "para", "sent").alias("doc_id"), F.explode(F.filter("keys", lambda t: F.contains(F.lower("sentence"), t))).alias("term"))
    p = settle(p)
    v = settle(K.document_frequency(p, 1, 1 << 62))
    return N.links(N.dice(p, v), v, sents.count(), 5)


_WORDS = "ws AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM documents)"
_GRAMS = lambda n: f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) AS g FROM ws WHERE len(w) >= {n}"
_PHRASES = f"{_WORDS}, gr AS (SELECT doc_id, g, count(*) AS tf FROM ({' UNION ALL '.join(map(_GRAMS, (2, 3, 4)))}) GROUP BY ALL HAVING count(*) >= 2), wi AS (SELECT DISTINCT doc_id, unnest([g[1:len(g) - 1], g[2:len(g)]]) AS g, tf FROM gr WHERE len(g) > 2)"


@query("kp02_repeated_phrases", f"WITH {_PHRASES} SELECT doc_id, array_to_string(g, ' ') AS term, len(g)::INT AS words, tf FROM gr ANTI JOIN wi USING (doc_id, g, tf)")
def repeated_phrases(spark, d):
    return S.phrases(_docs(spark, d))


_STOP = ["the", "a", "an", "of", "and", "to", "in", "der", "die", "das", "und", "la", "le", "de", "el"]
_STOPS = "(" + ", ".join(f"'{w}'" for w in _STOP) + ")"


@query("kp03_cleared_phrases", f"WITH {_PHRASES}, x AS (SELECT doc_id, g, tf, list_filter(range(1, len(g) + 1), lambda i: g[i] NOT IN {_STOPS}) AS good FROM gr ANTI JOIN wi USING (doc_id, g, tf)) SELECT doc_id, array_to_string(g[good[1]:good[-1]], ' ') AS term, sum(tf)::BIGINT AS tf FROM x WHERE len(good) > 0 GROUP BY ALL")
def cleared_phrases(spark, d):
    return S.phrases(_docs(spark, d)).withColumn("term", S.cleared(F.col("term"), _STOP)).filter("term is not null").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


_KEYWORDS = f"""{_WORDS}, tt AS (SELECT doc_id, term, tf, 1 AS n FROM ({_POSTINGS}) WHERE length(term) >= 4 UNION ALL SELECT doc_id, array_to_string(g, ' '), count(*), 2 FROM ({_GRAMS(2)}) GROUP BY doc_id, g HAVING count(*) >= 2),
t AS (SELECT doc_id, term, tf, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf * n DESC, term) AS place FROM tt) WHERE place <= 12)"""


@query("ag10_topics", f"WITH {_KEYWORDS} SELECT doc_id, term, tf, place FROM t")
def topics(spark, d):
    return S.topics(_docs(spark, d)).withColumn("place", F.col("place").cast("bigint"))


_SCORES = rf"""{_WEIGHTS}, {_KEYWORDS}, m AS (SELECT *, max(tf) OVER (PARTITION BY doc_id) AS most FROM t),
c AS (SELECT fit.*, tf, most, (length(sentence) - length(replace(lower(sentence), term, ''))) // length(term) AS n FROM fit JOIN m USING (doc_id)),
z AS (SELECT doc_id, para, sent, sentence, round(sum(n * (0.5 + weight * tf / most)) / pow(sum(n), 0.375), 4)::DOUBLE AS score FROM c WHERE n > 0 GROUP BY ALL)"""


@query("tx24_sentence_rank", f"WITH {_SCORES} SELECT doc_id, para, sent, score FROM z")
def sentence_rank(spark, d):
    return _spread(S.scores(_sections(spark, d)), F.col("scores")).drop("sentence", "n")


@query("ag11_summary", f"WITH {_SCORES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent) AS place, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, para, sent) AS r FROM z) WHERE r <= 6")
def summary(spark, d):
    found = S.scores(_sections(spark, d)).select("doc_id", F.posexplode_outer(S.best(F.col("scores"), F.lit(6))).alias("place", "x")).filter("x is not null")
    return found.select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), "x.sentence", "x.score")


@query("pf08_stop_words", f"SELECT doc_id, term, tf FROM ({_POSTINGS}) WHERE term NOT IN {_STOPS}")
def stop_words(spark, d):
    """Stop words of up to three letters, whose stems are themselves, as are the words of such stems."""
    p = K.postings(_docs(spark, d))
    stop = spark.createDataFrame([(w,) for w in _STOP], "word string")
    return S.without_stop_words(p.filter(F.length("term") <= 3), stop).unionByName(p.filter(F.length("term") > 3))


@query("pf09_manual_terms", f"SELECT doc_id, term, tf FROM ({_POSTINGS}) WHERE term IN (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM benchmark)")
def manual_terms(spark, d):
    return S.of_terms(K.postings(_docs(spark, d)), K.tokens(table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")))


@query("tx07_stem")
def stem(spark, d):
    words = K.tokens(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("n"))
    return words.groupBy(T.stems("term").alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("tx27_journal_match")
def journal_match(spark, d):
    """Names shortened to three letters a word, against all names."""
    full = table(spark, d, "part").select(F.upper("p_name").alias("full")).distinct()
    short = full.select(F.array_join(F.transform(F.split("full", " "), lambda w: F.substring(w, 1, 3)), " ").alias("short")).distinct()
    return K.matched_names(short, full)


_COS = f"sims AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


def _pairs(spark, d):
    return C.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", CUT)


@query("cl02_cosine_pairs", f"WITH {_COS} SELECT i, j, sim FROM sims WHERE sim >= {CUT}")
def cosine_pairs(spark, d):
    return _pairs(spark, d)


@query("cl04_single_link", f"WITH RECURSIVE {_COS}, e AS MATERIALIZED (SELECT i AS x, j AS y FROM sims WHERE sim >= {CUT} UNION ALL SELECT j, i FROM sims WHERE sim >= {CUT}), r(node, now) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.y FROM r JOIN e ON r.now = e.x) SELECT node, min(now) AS cluster FROM r GROUP BY node")
def single_link(spark, d):
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"))
    return N.components(nodes, _pairs(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query("cl03_complete_link")
def complete_link(spark, d):
    return C.complete_link(table(spark, d, "embeddings").select(F.col("vec_id").alias("node")), settle(_pairs(spark, d)))


@query("cl08_mds_map")
def mds_map(spark, d):
    return C.landmark_map(table(spark, d, "embeddings"), "vec_id", "embedding", 2).select("vec_id", F.round(F.col("at")[0], 4).alias("x"), F.round(F.col("at")[1], 4).alias("y"))


@query("cl13_svd")
def svd(spark, d):
    """Singular values of the term x language counts, with the trend of the first direction over languages."""
    cells = K.tokens(_docs(spark, d), "lang").groupBy("term", "lang").agg(F.count("*").cast("double").alias("v"))
    cells = settle(cells.filter("lang is not null"))
    langs = sorted(r[0] for r in cells.select("lang").distinct().collect())
    s, v = C.tall_svd(cells, "term", "lang", "v", langs)
    return spark.createDataFrame([(x, i + 1, round(float(s[i]), 4), round(float(s[0] * v[i, 0]), 4)) for i, x in enumerate(langs)], "lang string, k int, singular double, trend double")


@query("cl15_ols_trend", f"WITH t AS (SELECT n_name, year(o_orderdate) AS y, count(*)::DOUBLE AS n FROM {_ON} GROUP BY ALL) SELECT n_name, round(regr_slope(n, y), 4) AS slope, round(regr_intercept(n, y), 2) AS intercept FROM t GROUP BY n_name")
def ols_trend(spark, d):
    t = _orders_nations(spark, d).groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("n"))
    return t.groupBy("n_name").agg(F.round(F.regr_slope("n", "y"), 4).alias("slope"), F.round(F.regr_intercept("n", "y"), 2).alias("intercept"))


@query("cl16_ols_multi", "WITH c AS (SELECT covar_pop(l_extendedprice, l_quantity) AS ya, covar_pop(l_extendedprice, l_discount) AS yb, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb FROM lineitem), t AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS a, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b, * FROM c) SELECT unnest(['constant', 'l_quantity', 'l_discount']) AS name, unnest([round(my - a * ma - b * mb, 2), round(a, 2), round(b, 2)]) AS theta FROM t")
def ols_multi(spark, d):
    r = C.regression(table(spark, d, "lineitem").withColumn("constant", F.lit(1.0)), "l_extendedprice", ["constant", "l_quantity", "l_discount"])
    return spark.createDataFrame([(n, round(float(v), 2)) for n, v in zip(["constant", "l_quantity", "l_discount"], r["theta"], strict=True)], "name string, theta double")


def _tree(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return c.union(n).union(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("top")))


@query("gr08_semantic_class", "WITH RECURSIVE e AS MATERIALIZED (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'top' FROM region), u(word, now, depth) AS (SELECT child, child, 0 FROM e WHERE child LIKE 'c%' UNION ALL SELECT word, parent, depth + 1 FROM u JOIN e ON now = child) SELECT now AS ancestor, count(DISTINCT word) AS n, min(depth)::INT AS nearest FROM u WHERE depth > 0 GROUP BY now")
def semantic_class(spark, d):
    up = N.closure(_tree(spark, d)).filter("depth > 0 and node like 'c%'")
    return up.groupBy("ancestor").agg(F.count_distinct("node").alias("n"), F.min("depth").alias("nearest"))


@query("gr09_common_terms")
def common_terms(spark, d):
    words = table(spark, d, "customer").select(F.col("c_name").alias("word"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return N.common_terms(words, _tree(spark, d), 5)


@query("sk04_tagged_export", "SELECT o_orderkey, 'UT ' || o_orderkey || chr(10) || 'PY ' || year(o_orderdate) || chr(10) || 'CR ' || string_agg(l_partkey || ', ' || l_suppkey, chr(10) || '   ' ORDER BY l_linenumber, l_partkey, l_suppkey) || chr(10) || 'ER' AS record FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def tagged_export(spark, d):
    cites = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x: F.concat_ws(", ", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), "\n")
    rows = table(spark, d, "orders").join(cites, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", tagged_record({"UT": F.col("o_orderkey"), "PY": F.year("o_orderdate"), "CR": listed}).alias("record"))


@query("sk15_split_buckets", "SELECT doc_id, floor((sum(length(text)) OVER (ORDER BY doc_id) - length(text)) / 200000)::BIGINT AS bucket FROM documents")
def split_buckets(spark, d):
    return K.size_buckets(_docs(spark, d), "doc_id", F.length("text"), 200_000)


@query("tx30_paragraphs", "SELECT doc_id, line, coalesce(n * 4 < before * 3, false) AS short, coalesce(lag(n * 4 < before * 3) OVER (PARTITION BY doc_id ORDER BY line), false) AS start FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM (SELECT doc_id, j - 1 AS line, length(p[j]) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))))")
def paragraphs(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line")
    t = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc_id", F.col("line").cast("bigint").alias("line"), F.length("s").alias("n"))
    t = t.withColumn("short", F.coalesce(F.col("n") * 4 < F.lag("n").over(w) * 3, F.lit(False)))
    return t.select("doc_id", "line", "short", F.coalesce(F.lag("short").over(w), F.lit(False)).alias("start"))


@query("tx01_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS slashed, year(o_orderdate) || '/' || strftime(o_orderdate, '%m') || '/' || day(o_orderdate) AS parsed FROM orders")
def dates(spark, d):
    day = F.col("o_orderdate")
    prose = F.concat(F.date_format(day, "MMMM"), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.slashes(F.date_format(day, "yyyy-MM-dd")).alias("slashed"), T.long_date(prose).alias("parsed"))


@query("js01_json_field", "SELECT (props ->> '$.k')::INT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_field(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
