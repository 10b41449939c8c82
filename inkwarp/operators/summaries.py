"""Extractive summaries: sentences, their weights and scores, key phrases, topics.

Sentences of a text, their weights and scores are arrays in the text's own row; only counts of terms are grouped.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from inkwarp.functions.text import let, stems

_LETTERS = re.compile("[a-z]+")
CLUES = "advantage avoid cost costly decrease difficult effectiveness efficiency goal important improved increase issue limit needed overhead performance problem reduced resolve shorten simplify suffer superior weakness".split()


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, para, sent, sentence): paragraphs are lines, sentences end with . ! or ? (KP-01)."""
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "p"))
    return paras.select("doc_id", "para", F.posexplode(F.regexp_extract_all("p", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))).alias("sent", "s")).select("doc_id", "para", "sent", F.trim("s").alias("sentence")).filter("sentence <> ''")


def good_paragraphs(paras: Column) -> Column:
    """Paragraphs without those on figures or steps, without tags, each with a period at its end (PF-04)."""
    bare = F.transform(F.filter(paras, lambda p: ~p.rlike("FIG|Figure") & ~p.rlike(r"step\s+\d+")), lambda p: F.regexp_replace(p, "<[^<]*>", ""))
    return F.transform(bare, lambda p: F.when(p.rlike(r"\.\s*$"), p).otherwise(F.concat(p, F.lit(" ."))))


def weighted(paras: Column, section: Column) -> Column:
    """array<struct<para, sent, sentence, weight>> of good paragraphs (TX-25).

    A paragraph's first sentence has 1.5, but for abstracts, others 1; twice that in the first two paragraphs, four times in the last
    but one, and in the last of a task.
    """
    each = F.flatten(F.transform(good_paragraphs(paras), lambda p, i: F.transform(F.filter(F.transform(F.regexp_extract_all(p, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != ""), lambda x, j: F.struct(i.alias("para"), j.alias("sent"), x.alias("sentence")))))

    def one(x: Column, last: Column) -> Column:
        lead = F.when((x["sent"] == 0) & ~F.equal_null(section, F.lit("abstract")), 1.5).otherwise(1.0)
        late = ((x["para"] == last) & F.equal_null(section, F.lit("task"))) | (x["para"] == last - 1)
        return F.struct(x["para"].alias("para"), x["sent"].alias("sent"), x["sentence"].alias("sentence"), (lead * F.when(x["para"] <= 1, 2.0).when(late, 4.0).otherwise(1.0)).alias("weight"))

    return let(each, lambda e: let(F.array_max(F.transform(e, lambda x: x["para"])), lambda last: F.transform(e, lambda x: one(x, last))))


def fit_sentences(sents: Column) -> Column:
    """Sentences that begin with a capital (a number in brackets may stand before it), have five blanks or more and don't end in i or e alone (PF-05).

    After one that ends in "sub ." none is fit.
    """
    begins = lambda x: x["sentence"].rlike(r"^(\[\s\d+\s\]\s*)?[A-Z]") & ~x["sentence"].rlike(r"\s[ie]$")
    numbered = F.transform(sents, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    five = lambda x: F.length(F.regexp_replace(x["sentence"], "[^ ]", "")) >= 5

    def kept(rows: Column, sub: Column) -> Column:
        return F.transform(F.filter(rows, lambda y: begins(y["x"]) & (y["i"] <= F.coalesce(sub, y["i"])) & five(y["x"])), lambda y: y["x"])

    return let(numbered, lambda rows: let(F.array_min(F.transform(F.filter(rows, lambda y: begins(y["x"]) & y["x"]["sentence"].rlike(r"sub \.$")), lambda y: y["i"])), lambda sub: kept(rows, sub)))


def spliced(sents: Column) -> Column:
    """Of more than 50 sentences, those from 30 % on are left out, 60 % of them (TX-26)."""
    low = lambda x: F.floor(F.size(x) * 3 / 10).cast("int")
    out = lambda x: F.floor(F.size(x) * 6 / 10).cast("int")
    return let(sents, lambda x: F.when(F.size(x) > 50, F.concat(F.slice(x, F.lit(1), low(x)), F.slice(x, low(x) + out(x) + 1, F.size(x)))).otherwise(x))


def scored(sents: Column, terms: Column) -> Column:
    """array<struct<para, sent, sentence, score>> of the sentences with a term: sum over occurrences of 0.5 + weight tf / most tf, by occurrences to the power 0.375 (TX-23, TX-24). terms: array<struct<term, tf>>, in lower case."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def one(x: Column, own: Column, most: Column, low: Column) -> Column:
        times = lambda t: ((F.length(low) - F.length(F.replace(low, t["term"], F.lit("")))) / F.length(t["term"])).cast("int")
        add = lambda a, t: let(times(t), lambda n: F.struct((a["sum"] + n * (0.5 + x["weight"] * t["tf"] / most)).alias("sum"), (a["n"] + n).alias("n")))
        score = lambda f: F.round(f["sum"] / F.pow(F.greatest(f["n"], F.lit(1)), F.lit(0.375)), 4)
        return let(F.aggregate(own, zero, add), lambda f: F.struct(x["para"].alias("para"), x["sent"].alias("sent"), x["sentence"].alias("sentence"), score(f).alias("score"), f["n"].alias("n")))

    every = let(terms, lambda own: let(F.array_max(F.transform(own, lambda t: t["tf"])).cast("double"), lambda most: F.transform(sents, lambda x: let(F.lower(x["sentence"]), lambda low: one(x, own, most, low)))))
    return F.filter(every, lambda x: x["n"] > 0)


def best(scores: Column, k: Column) -> Column:
    """The k sentences of highest score (of equal ones the first), in the order of the text (AG-11)."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("x"))))
    return F.transform(F.array_sort(F.transform(F.slice(order, F.lit(1), k), lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def phrases(docs: DataFrame, least: int = 2, longest: int = 4) -> DataFrame:
    """(doc_id, term, words, tf): runs of two to longest words that a document has least times or more, without those that are always part of one longer run (KP-02). A row is a document."""

    @F.pandas_udf(ArrayType(StructType([StructField("term", StringType()), StructField("words", IntegerType()), StructField("tf", LongType())])))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            words = _LETTERS.findall((text or "").lower())
            of = {n: {g: k for g, k in Counter(zip(*(words[i:] for i in range(n)), strict=False)).items() if k >= least} for n in range(2, longest + 1)}
            within = {(part, k) for n in range(3, longest + 1) for g, k in of[n].items() for part in (g[:-1], g[1:])}
            return [{"term": " ".join(g), "words": n, "tf": k} for n, grams in of.items() for g, k in grams.items() if (g, k) not in within]

        return texts.map(one, na_action=None)

    return docs.select("doc_id", F.inline_outer(run("text"))).filter("term is not null")  # without outer, a filter on sizes would run it twice


def cleared(term: Column, stop: list[str]) -> Column:
    """A phrase without stop words at its ends, null where none is left (KP-03)."""
    good = lambda words: F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~F.element_at(words, i).isin(*stop))
    cut = lambda words, at: F.when(F.size(at) > 0, F.array_join(F.slice(words, F.array_min(at), F.array_max(at) - F.array_min(at) + 1), " "))
    return let(F.split(term, " "), lambda words: let(good(words), lambda at: cut(words, at)))


def without_stop_words(posting: DataFrame, stop: DataFrame) -> DataFrame:
    """Postings whose term's stem is none of a stop word (word) (PF-08)."""
    out = stop.select(stems("word").alias("stem")).distinct()
    return posting.withColumn("stem", stems("term")).join(out, "stem", "left_anti").drop("stem")


def of_terms(posting: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the terms of a user's list (PF-09)."""
    return posting.join(terms.select("term").distinct(), "term", "left_semi")


def key_terms(text: Column, k: int = 12, shortest: int = 4) -> Column:
    """array<struct<term, tf>>: a text's k first topics by tf times words: words of shortest letters or more, and pairs of words that it repeats (AG-09, AG-10).

    Counting a text's words is the work of one row, so it is done in Arrow batches without an exchange.
    """

    @F.pandas_udf(ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            words = _LETTERS.findall(text.lower())
            found = [(-n, w, n) for w, n in Counter(words).items() if len(w) >= shortest]
            found += [(-2 * n, f"{a} {b}", n) for (a, b), n in Counter(zip(words, words[1:], strict=False)).items() if n > 1]
            return [{"term": t, "tf": n} for _, t, n in heapq.nsmallest(k, found)]

        return texts.map(one, na_action=None)

    return run(text)


def topics(docs: DataFrame, k: int = 12, shortest: int = 4) -> DataFrame:
    """(doc_id, term, tf, place): key_terms of each document (doc_id, text)."""
    found = docs.select("doc_id", F.posexplode_outer(key_terms(F.col("text"), k, shortest)).alias("place", "t"))  # without outer, a filter on sizes would run it twice
    return found.filter("t is not null").select("doc_id", "t.term", "t.tf", (F.col("place") + 1).alias("place"))


def scores(docs: DataFrame, k: int = 12) -> DataFrame:
    """(doc_id, scores) of documents (doc_id, text, section): the scored fit sentences by the document's topics, null where it has none; lines are paragraphs, null texts are left out."""
    sents = fit_sentences(weighted(F.split("text", "\n"), F.col("section")))
    found = docs.filter("text is not null").select("doc_id", "text", "section", key_terms(F.col("text"), k).alias("terms"))
    return found.select("doc_id", F.when(F.size("terms") > 0, scored(sents, F.col("terms"))).alias("scores"))


@F.pandas_udf(ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))
def word_counts(texts: pd.Series) -> pd.Series:
    """The words of each text with their numbers. They are the work of one row, so nothing is exchanged."""
    return texts.map(lambda text: [{"term": t, "tf": n} for t, n in sorted(Counter(_LETTERS.findall(text.lower())).items())], na_action="ignore")


def section_summaries(rows: DataFrame, most: int = 6, fewer: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, section, summary) of sections (doc_id, section, title, paras): the best sentences by all words of section and title (TX-26).

    A row is a section. Words in the title count with their tf there too; in tasks, summaries and features CLUES count once more, and of many sentences
    the middle is left out. fewer: sentences for sections that have another number than most.
    """
    rows = rows.filter(F.size("paras") > 0)
    clue = F.when(F.col("section").isin("task", "summary", "features"), " ".join(CLUES)).otherwise("")
    every = F.concat_ws(" ", F.array_join("paras", " "), F.coalesce("title", F.lit("")), clue)
    k = F.lit(most)
    for name, n in (fewer or {}).items():
        k = F.when(F.col("section") == name, n).otherwise(k)
    sents = fit_sentences(weighted(F.col("paras"), F.col("section")))
    rows = rows.filter("doc_id is not null and section is not null").filter(F.lower(every).rlike("[a-z]"))  # a filter on the counts would make them twice
    found = rows.withColumn("terms", word_counts(every)).withColumn("sents", F.when(F.col("section").isin("task", "summary", "features"), spliced(sents)).otherwise(sents))
    return found.select("doc_id", "section", F.transform(best(scored(F.col("sents"), F.col("terms")), k), lambda x: x["sentence"]).alias("summary"))
