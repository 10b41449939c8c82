import json

import pytest
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.operators import store
from inkwarp.sources import readers as R
from inkwarp.sources import writers as W
from inkwarp.streaming import incremental


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def test_readers(spark, tmp_path):
    p = put(tmp_path, "list.txt", "# ids\r\n5,123,456\r\r\n 42 x\n5123456\n\nabc\n")
    assert [r[0] for r in R.patent_numbers(spark, p).collect()] == ["42", "5123456"]
    v, e = R.pajek(spark, put(tmp_path, "n.net", '*Vertices 2\n1 "b"\n2 "a" 0.1\n*Edges\n1 2 3\n2 1 1\n'))
    assert v.count() == 2 and [tuple(r) for r in e.collect()] == [("a", "b")]
    assert {tuple(r) for r in R.postings(spark, put(tmp_path, "p.txt", "cat\t1,2,7,1,\n")).collect()} == {("cat", "1", 2), ("cat", "7", 1)}
    assert [tuple(r) for r in R.listed_postings(spark, put(tmp_path, "q.txt", "1 : cat : 3 : 1\t2\n2 : dog : 0 : \n")).collect()] == [("cat", 3)]
    assert [tuple(r) for r in R.similarities(spark, put(tmp_path, "s.txt", "2\t1\t0.5\n")).collect()] == [(1, 2, 0.5)]
    assert {r[0] for r in R.stop_words(spark, put(tmp_path, "w.txt", "# x\nThe of\nof\n")).collect()} == {"the", "of"}
    d = R.delimited(spark, put(tmp_path, "d.txt", "A\tB\n1\t2\n3\n"), ["A", "B"])
    assert {(r["A"], r["corrupt"]) for r in d.collect()} == {("1", None), (None, "3")}
    assert R.bibliographic_csv(spark, put(tmp_path, "c.csv", 'T,U\n"a, b","x\ny"\n')).first()["U"] == "x\ny"
    assert R.settings(put(tmp_path, "x.ini", "a=1\n[g]\n# no\nk = 1\nk=2\n")) == {"": {"a": ["1"]}, "g": {"k": ["1", "2"]}}
    t = {(r["tag"], r["value"]) for r in R.tagged(spark, put(tmp_path, "t.txt", "AU Li\n   Wu\nTI A\nER\nAU Xu\nER\n")).collect()}
    assert t == {("AU", "Li; Wu"), ("TI", "A"), ("AU", "Xu")}


def test_pages_and_json(spark, tmp_path):
    (tmp_path / "h" / "in").mkdir(parents=True)
    put(tmp_path / "h" / "in", "a.html", "x" * 1200)
    put(tmp_path / "h", "b.htm", "short")
    assert sorted(r["complete"] for r in R.pages(spark, str(tmp_path / "h")).collect()) == [False, True]
    answer = {"patents": [{"patent_id": "1", "patent_date": "2001-02-03", "patent_title": "T", "inventors": [{"inventor_sequence": 1, "inventor_name_last": "B"}, {"inventor_sequence": 0, "inventor_name_last": "A", "inventor_city": "X"}]}]}
    r = R.patents(spark, put(tmp_path, "p.json", json.dumps(answer))).first()
    assert (r["patent_no"], r["inventors"], str(r["issued_date"])) == ("1", "A, X; B", "2001-02-03")


def test_writers(spark, tmp_path):
    text = spark.range(1).select(W.tagged_record({"UT": F.lit(1), "AB": F.lit(""), "CR": F.lit("a\nb")}).alias("t")).first()["t"]
    assert text == "UT 1\nCR a\n   b\nER"
    v = spark.createDataFrame([("b",), ("a",)], "label string")
    e = spark.createDataFrame([("a", "b", 2)], "a string, b string, weight int")
    W.write_pajek(v, e, str(tmp_path / "net"))
    v2, e2 = R.pajek(spark, str(tmp_path / "net"))
    assert v2.count() == 2 and [tuple(r) for r in e2.collect()] == [("a", "b")]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    path = str(tmp_path / "stored")
    rows.limit(1).write.parquet(path)
    for _ in range(2):  # a second run adds nothing
        W.write_new(rows, spark.read.parquet(path), ["k"], path)
    assert spark.read.parquet(path).count() == 2
    W.write_by_year(rows.withColumn("year", F.lit(2001)), str(tmp_path / "y"))
    assert (tmp_path / "y" / "year=2001").exists()
    W.write_split(spark.range(10), str(tmp_path / "z"), 3)
    assert len(list((tmp_path / "z").glob("*.csv"))) >= 4


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0, 2.0, 1.0), (2, 2.0, 4.0, 1.0), (2, 2.0, 4.0, 1.0)], "k int, x double, y double, weight double").write.parquet(path)
    rows = incremental.new_rows(spark, path, "k int, x double, y double, weight double", ["k"])
    q = incremental.regression_sums(rows, "y", "x").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("sums").first()) == (2.0, 3.0, 6.0, 5.0, 10.0)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_exports_without_header_and_with_other_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ty\n1\t2\n1\t2\t3\n\n4\t\n")
    (tmp_path / "b.txt").write_text("y\tx\n5\t6\n")
    (tmp_path / "c.txt").write_text("")
    rows, files = R.related_records(spark, str(tmp_path), ["x", "y"], [1])
    assert sorted(r["y"] for r in rows.collect()) == ["", "2"]
    assert sorted((r["good"], r["rows"], r["mismatched"]) for r in files.collect()) == [(False, 2, 0), (True, 2, 1)]


def test_tables_of_distances_with_faults(spark, tmp_path):
    (tmp_path / "t").write_text("# five\n3\na\nb\nc\n1\n2\n\n3\n")
    found = sorted(tuple(r) for r in R.distances(spark, str(tmp_path / "t")).collect())
    assert found == [(1, 0, "b", "a", 1.0), (2, 0, "c", "a", 2.0), (2, 1, "c", "b", 3.0)]
    (tmp_path / "t").write_text("3\na\nb\nc\n1\n2\n")
    with pytest.raises(Exception, match="missing"):
        R.distances(spark, str(tmp_path / "t")).collect()
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    (tmp_path / "i").write_text("2\na\n1\n2\nb\n3\n4\n")
    assert sorted((r["label"], *r["at"]) for r in R.placed(spark, str(tmp_path / "i"), labels, 2).collect()) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    for text, message in (("3\na\n1\n2\n", "dimension"), ("2\na\n1\n2\n", "label b"), ("2\na\n1\n2\nb\n3\n4\nc\n5\n6\n", "label c"), ("2\na\n1\n2\nb\n3\n", "missing")):
        (tmp_path / "i").write_text(text)
        with pytest.raises(Exception, match=message):
            R.placed(spark, str(tmp_path / "i"), labels, 2).collect()


def test_settings_of_the_first_file(tmp_path):
    (tmp_path / "b").write_text("a=1,2\na=3\n[g]\na=x\nc=y,\n")
    found = R.first_settings([str(tmp_path / "none"), str(tmp_path / "b")])
    assert R.overlaid(found, "g") == {"a": ["x"], "c": ["y"]} and R.overlaid(found, "none") == {"a": ["1", "2", "3"]}
    assert R.first_settings([str(tmp_path / "none")]) == {"": {}}


def test_databases(spark):
    url = "jdbc:derby:memory:inkwarp;create=true"
    spark.createDataFrame([(1, "x" * 50), (2, None)], "id int, t string").write.format("jdbc").options(url=url, dbtable="docs", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    found = R.jdbc(spark, url, "docs", 20, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted((r[0], r[1]) for r in found.collect()) == [(1, "x" * 20), (2, None)]


def test_searches_and_pages(spark):
    t = spark.createDataFrame([(1, "Solar cell", "a"), (2, "cell", None), (3, None, "b")], "id int, t string, o string")
    ids = lambda *x: sorted(r["id"] for r in R.search(t, *x).collect())
    assert ids(("t", "CELL")) == [1, 2] and ids(("t", "cell"), ("o", "a")) == [1] and ids(("t", "solar"), ("o", "B"), "OR") == [1, 3] and ids(("t", "cell"), ("o", "a"), "and not") == [2]
    assert [r["place"] for r in R.hits(t, ["id"], 2).collect()] == [1, 2]
    assert "url=http://x" in W.redirect("http://x")


def test_a_store_keeps_numbers_and_rows(spark, tmp_path):
    page = lambda no, country: {"pat_no": no, "inventors": f"Lee; A (Town, {country})", "cites": []}

    def pages(*rows):
        df = spark.createDataFrame([tuple({**dict.fromkeys(P.FIELDS), **r}[f] for f in P.FIELDS) + (r["cites"], "html") for r in rows], ", ".join(f"{f} string" for f in P.FIELDS) + ", cites array<string>, html string")
        return {k: v for k, v in store.tables(df).items() if k in ("owner", "class", "full_text")}

    folder = str(tmp_path / "s")
    store.save(pages(page("1", "ZZ"), page("", "NO")), folder)
    store.save(pages(page("2", "AA"), page("1", "QQ")), folder)
    numbers = {r["country"]: r["country_no"] for r in store.stored(spark, folder, "country").collect()}
    owners = {r["patent_no"]: r["country_no"] for r in store.stored(spark, folder, "owner").collect()}
    assert numbers["ZZ"] == 1 and owners == {"1": numbers["ZZ"], "2": numbers["AA"]} and len(set(numbers.values())) == len(numbers)
    assert store.stored(spark, folder, "full_text").count() == 2 and store.stored(spark, folder, "none") is None
    assert {r["patent_no"]: r["existed"] for r in store.has(spark.createDataFrame([("1",), ("9",)], "patent_no string"), store.stored(spark, folder, "owner"), "patent_no").collect()} == {"1": True, "9": False}
    assert store.summary_pages(spark.createDataFrame([("1", 1, "task", "b"), ("1", 0, "abstract", None)], "patent_no string, sequence int, type string, summary string")).first()["html"] == "<h3>abstract</h3>\n\n<HR>\n<h3>task</h3>\nb"
