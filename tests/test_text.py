import pytest
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,light,deep", [("ladies", "lady", "ladi"), ("studies", "study", None), ("studied", "study", None), ("computers", "computer", "comput"), ("computing", "comput", None), ("running", "run", None), ("agreed", "agree", "agre"), ("process", "proce", None), ("analysis", "analysi", "analysis"), ("hoping", "hop", None), ("relational", None, "relat"), ("houses", None, "houses"), ("cat", "cat", "cat"), ("x-ray", "x-ray", "x-ray")])
def test_stem(word, light, deep):
    assert light is None or T.stem(word) == light
    assert deep is None or T.stem(word, True) == deep


def test_journal_match():
    assert T.journal_match("4OR-Q J OPER RES", "4OR-A QUARTERLY JOURNAL OPERATIONS RESEARCH")
    assert T.journal_match("ACOUST PHYS+", "ACOUSTICAL PHYSICS") and T.journal_match("ACTA ACUST UNITED AC", "ACTA ACUSTICA UNITED WITH ACUSTICA")
    assert not T.journal_match("PHYS", "ACTA PHYSICA") and not T.journal_match(None, "X") and not T.journal_match("X", "")


def test_dates(spark):
    lit = F.lit
    assert one(spark, T.slash_date(lit(None).cast("int"))) == "9999/01/01" and one(spark, T.slash_date(lit(2003))) == "2003/01/01"
    assert one(spark, T.slash_date(lit(2003), lit(11), lit(2))) == "2003/11/2"
    assert [one(spark, T.month(lit(m))) for m in ("Jan", "December", "x")] == ["01", "12", None]
    assert one(spark, T.long_date(lit("May 3, 1999"))) == "1999/05/3" and one(spark, T.long_date(lit("soon"))) == "soon"
    assert one(spark, T.slashes(lit("2001-02-03"))) == "2001/02/03" and one(spark, T.year(lit("2001/02/03"))) == "2001"


def test_places_and_numbers(spark):
    lit = F.lit
    assert [one(spark, T.country(lit(a))) for a in ("Univ X, MD 20742 USA", "Natl Taiwan Univ, Taiwan", "Somewhere, MA 02139", "")] == ["USA", "TAIWAN", "USA", None]
    assert one(spark, T.number(lit("1.124"))) == 1124 and one(spark, T.number(lit("0,46"))) == 0.46
    assert one(spark, T.without_copyright(lit("Good. (C) 2003 Elsevier Ltd. All rights reserved."))) == "Good."
    assert one(spark, T.plain(lit("<p>a <b>b</b><script>x<1</script>\n c</p>"))) == "a b c"
    assert one(spark, T.occurrences(lit("Cat catalog cAt"), lit("cat"))) == 3 and one(spark, T.occurrences(lit("a"), lit(""))) == 0
    assert one(spark, T.bucket(lit("5123456"))) == "56" and one(spark, T.lines(lit("a; b"))) == "a\n   b"
    assert one(spark, T.rgb(*map(lit, (0.0, 0.0, 0.0, 0.0)))) == (255, 255, 255) and one(spark, T.rgb(*map(lit, (0.0, 0.0, 0.0, 1.0)))) == (0, 0, 0)
    assert one(spark, T.decoded(lit("a=x+y&b=%41"))) == {"a": "x y", "b": "A"}
    assert one(spark, T.decoded(lit("a=1&a=2&b&c=%zz"))) == {"a": "1\x002", "b": "", "c": None} or one(spark, T.decoded(lit("a=1&a=2&b"))) == {"a": "1\x002", "b": ""}
    assert one(spark, T.address(lit("Li, A, Dept, Univ, City, Taiwan"))) == "[Li, A] Univ, Dept, City, Taiwan." and one(spark, T.address(lit("Li, A"))) == "[Li, A] , , , A."
    assert one(spark, T.title_and_abstract(lit("T\n\n\n\n\n Abstract x\n\n\n\n\nrest"))) == "T\n\n\n\n\n Abstract x\n\n\n\n\n" and one(spark, T.title_and_abstract(lit("T"))) == "T"


def test_owners_and_references(spark):
    found = one(spark, T.owners(F.lit("Smith; John (Austin, TX), Acme Corporation (Tokyo, JP)")))
    assert [tuple(x) for x in found] == [("Smith, John", "Austin", "TX", "US", 1), ("Acme Corporation", "Tokyo", None, "JP", 2)]
    assert tuple(one(spark, P.cited_patent(F.lit("4123456\tOct 1978\tDoe et al.\t123/45")))) == ("4123456", "1978/10/01", "Doe", "123/45")
    raw = one(spark, T.owners(F.lit("Acme (Bonn, DE), Huang; Smile (Tainan, TW), X Corp. (US), no place"), F.lit("Acme (Bonn, <b>DE</b>)")))
    assert [tuple(x) for x in raw] == [("Acme", "Bonn", None, "DE", 1), ("Huang, Smile", "Tainan", None, "TW", 1), ("X Corp.", None, None, "US", 2)]
    assert not one(spark, T.owners(F.lit(""))) and one(spark, T.owners(F.lit(None).cast("string"))) is None


def test_stems_column(spark):
    df = spark.createDataFrame([("Studies",), (None,)], "w string")
    assert [r[0] for r in df.select(T.stems("w")).collect()] == ["study", None]


def test_claims_contents_and_headlines(spark):
    claims = one(spark, P.claims(F.lit("What is claimed:<BR><BR>1. A.<br><br>more<BR><BR> <BR><BR>2. B of CLAIM 1.<BR><BR>12. C.")))
    assert [tuple(c) for c in claims] == [(1, True, "1. A.<BR><BR>more"), (2, False, "2. B of CLAIM 1."), (12, True, "12. C.")]
    found = one(spark, P.contents(F.lit("x<BR><BR>FIELD (OF)<BR><BR>a  b<BR><BR><BR><BR>c<BR><BR> <BR><BR>lost<BR><BR>A B C D E F G H I J<BR><BR>lost<BR><BR>END")))
    assert [(s["title"], s["body"]) for s in found] == [("FIELD (OF)", ["a b", "c"]), ("END", [])]
    assert one(spark, P.contents(F.lit(None).cast("string"))) is None and not one(spark, P.claims(F.lit("")))


def test_pages_without_what_is_looked_for(spark):
    for parse in (P.new_page, P.old_page):
        assert not any(v for v in parse("").values()) and not parse("<p>x").get("title")
    rows = spark.createDataFrame([(None,), ("<h3>Description</h3>",), ("<table><tr><td>a<td>b<p>c<p>d</table><h3>Abstract<p>The text",)], "h string")
    assert [r["p"]["abstract"] for r in rows.select(P.new_pages("h").alias("p")).collect()] == [None, None, None]
    t = P.tree("<div><p>a<p>b<br>c</div><ul><li>x<li>y</ul>")
    assert [c.text() for c in t.children] == ["abc", "xy"] and t.down("p", lambda n: "b" in n.text()).text() == "bc"


def test_free_citations(spark):
    c = one(spark, P.paper_reference(F.lit('Smith, J., "On widgets," Journal of Widgets, vol. 3, pp. 17-20, Jan. 1988.')))
    assert tuple(c) == (1, "1988/01/01", "3", "17", "Smith, J.", "On widgets", "Journal of Widgets")
    none = one(spark, P.paper_reference(F.lit("")))
    assert none["type"] == 0 and none["year"] == "9999/01/01" and none["title"] is None
