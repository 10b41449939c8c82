"""Tests of the third round's findings."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from inkwarp.functions import patents as P
from inkwarp.operators import clusters as C
from inkwarp.operators import networks as N
from inkwarp.operators import store as R
from inkwarp.operators import summaries as S
from inkwarp.plans import formats
from inkwarp.plans import patents as Q
from inkwarp.sources import readers as I
from inkwarp.sources import writers as O


def test_pages_of_one_row_group_are_parsed_on_all_cores(spark, tmp_path):
    pd.DataFrame({"c_custkey": range(800), "c_name": "N", "c_nationkey": 0, "c_mktsegment": "S"}).to_parquet(tmp_path / "customer.parquet", row_group_size=10_000)
    pd.DataFrame({"n_nationkey": [0], "n_name": ["X"]}).to_parquet(tmp_path / "nation.parquet")
    sizes = [len(x) for x in Q._composed(spark, str(tmp_path), k="k").rdd.glom().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 400


def test_elements_of_a_page_are_looked_at_once(monkeypatch):
    made, text = [], P.Node.text
    monkeypatch.setattr(P.Node, "text", lambda n: made.append(n) or text(n))
    page = P.new_page("<html><body>" + "".join(f"<div><p>{x}</p><p> </p><p>v{i}</p></div>" for i, x in enumerate(("Inventors:", "Assignee:", "Filed:", "Appl. No.:"))) + "<p>x</p>" * 50)
    assert [page[f] for f in ("inventors", "assignee", "filed", "apply_no")] == ["v0", "v1", "v2", "v3"] and len(made) < 100


def test_a_saved_table_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def country(n):
        made.add(1)
        return f"C{n % 3}"

    rows = spark.range(12).select(F.col("id").cast("string").alias("patent_no"), country("id").alias("country"))
    R.save({"info": rows}, str(tmp_path))
    assert made.value == 12
    names = R.stored(spark, str(tmp_path), "info").join(R.stored(spark, str(tmp_path), "country"), "country_no")
    assert {(r["patent_no"], r["country"]) for r in names.collect()} == {(str(i), f"C{i % 3}") for i in range(12)}


def test_pairs_of_documents_meet_whole_under_their_first_common_term(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB", 4)
    monkeypatch.setattr(N, "CELLS", 30)
    rng = np.random.default_rng(4)
    tf = rng.poisson(0.9, (60, 12)) * (rng.random((60, 12)) < np.linspace(0.05, 0.95, 12))
    df = spark.createDataFrame([(int(i), f"t{j}", int(tf[i, j])) for i, j in zip(*np.nonzero(tf), strict=True)], "doc_id bigint, term string, tf bigint")
    n = int((tf.sum(axis=1) > 0).sum())
    w = tf * np.log(n / np.maximum((tf > 0).sum(axis=0), 1))
    u = w / np.maximum(np.linalg.norm(w, axis=1), 1e-12)[:, None]
    asked = []
    monkeypatch.setattr(N, "_meet", lambda *x: asked.append(x))
    for cut in (0.1, 0.3, 0.8):
        want = {(i, j): round(float(u[i] @ u[j]), 4) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 4) >= cut}
        got = [tuple(r) for r in N.similar(df, cut).collect()]
        found = {(a, b): s for a, b, s in got}
        assert len(got) == len(found) and found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), atol=1.1e-4)
    assert not asked


def test_complete_link_of_more_than_five_thousand_members(spark):
    # a chain of 3,000 pairs, each tied to the next by one weak pair: one component of 6,000 members
    pairs = spark.range(3000).select((2 * F.col("id")).alias("i"), (2 * F.col("id") + 1).alias("j"), F.lit(0.9).alias("sim"))
    pairs = pairs.union(spark.range(2999).select(2 * F.col("id") + 1, 2 * F.col("id") + 2, F.lit(0.5)))
    merges = C.complete_link(spark.range(6000).toDF("node"), pairs).collect()
    assert sorted((r["component"], r["step"], r["left"], r["right"], r["sim"]) for r in merges) == [(0, k + 1, 2 * k, 2 * k + 1, 0.9) for k in range(3000)]


def test_complete_link_is_that_of_all_pairs_with_ties(spark):
    rng = np.random.default_rng(7)
    for share, levels in ((0.9, 3), (0.5, 10), (0.97, 2)):
        n = 24
        s = np.triu(np.ceil(rng.random((n, n)) * levels) / levels * (rng.random((n, n)) < share), 1)
        s = s + s.T
        want, clusters = [], [{i} for i in range(n)]
        while True:
            tried = [(min(s[i, j] for i in a for j in b), -min(a | b), -max(min(a), min(b)), a, b) for k, a in enumerate(clusters) for b in clusters[k + 1 :]]
            best = max(tried, key=lambda x: x[:3], default=(0,))
            if best[0] <= 0:
                break
            want.append((-best[1], -best[2], round(float(best[0]), 6)))
            clusters = [c for c in clusters if c not in best[3:]] + [best[3] | best[4]]
        pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(i + 1, n) if s[i, j]], "i bigint, j bigint, sim double")
        got = C.complete_link(spark.range(n).toDF("node"), pairs.union(pairs.limit(3))).collect()  # some pairs twice
        assert [(r["left"], r["right"], round(r["sim"], 6)) for r in sorted(got, key=lambda r: r["step"])] == want and len({r["component"] for r in got}) == 1


def test_tasks_leave_an_edge_a_node(monkeypatch):
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 300, (2, 4000))
    u, v = np.maximum(u, v), np.minimum(u, v)
    batches = [pa.RecordBatch.from_arrays([pa.array(u[k : k + 500]), pa.array(v[k : k + 500])], ["u", "v"]) for k in range(0, 4000, 500)]
    left = pa.Table.from_batches(list(N._stars(iter(batches)))).to_pandas()
    assert len(left) == len(set(u) | set(v)) - 1 and set(left["v"]) == {min(v)}


def test_words_of_a_section_are_counted_in_its_row(spark):
    rows = spark.createDataFrame([(1, "task", "Rotor", ["The engine drives the large engine rotor."]), (2, None, "x", ["The engine drives the large engine rotor."]), (3, "abstract", None, ["1 2 3 4 5 6."])], "doc_id int, section string, title string, paras array<string>")
    found = S.section_summaries(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "task", ["The engine drives the large engine rotor."])]


def test_coupled_items_are_counted_whole_under_their_first_common_value(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB", 5)
    rng = np.random.default_rng(11)
    data = sorted({(int(i), int(k)) for i, k in zip(rng.integers(0, 60, 240), rng.integers(0, 9, 240), strict=True)})
    of = [{k for j, k in data if j == i} for i in range(60)]
    df = spark.createDataFrame([*data, (None, 1), (1, None)], "i bigint, k int")
    for least in (1, 2, 3):
        want = {(i, j): len(of[i] & of[j]) for i in range(60) for j in range(i + 1, 60) if len(of[i] & of[j]) >= least}
        found = N.shared(df, "i", "k", least)
        got = [tuple(r) for r in found.collect()]
        assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_a_writer_adds_is_no_part_of_a_page(spark, tmp_path):
    texts = ["x" * 999, "y" * 1000, "z" * 998 + "\x00", "ü" * 999 + "\n", ""]
    spark.createDataFrame([(x,) for x in texts], "html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page"], r["complete"], r["n"]) for r in formats.saved_pages(spark, str(tmp_path)).collect()}
    assert got == {(hashlib.md5(x.encode()).hexdigest(), len(x) >= 1000, 1) for x in texts}


def test_saved_pages_are_in_a_folder_a_task(spark, tmp_path):
    O.write_pages(spark.range(40).repartition(5).select(F.concat(F.lit("p"), "id").alias("html")), str(tmp_path / "p"), "\x00")
    files = [x for x in (tmp_path / "p").rglob("part-*") if x.suffix == ".txt"]
    assert len(files) == 40 and len({x.parent for x in files}) == 5 and not [x for x in files if x.parent == tmp_path / "p"]
    assert sorted(r["html"] for r in I.pages(spark, str(tmp_path / "p"), names="part-*", end="\x00").collect()) == sorted(f"p{i}" for i in range(40))


def test_pairs_of_vectors_leave_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 50)
    x = np.random.default_rng(12).normal(size=(90, 3))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [(r["i"], r["j"]) for r in C.cosine_pairs(df, "id", "v", 0.5).collect()]
    assert sorted(got) == [(i, j) for i in range(90) for j in range(i + 1, 90) if round(float(u[i] @ u[j]), 4) >= 0.5]
