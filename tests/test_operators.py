import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarp.functions import text as T
from inkwarp.operators import clusters as C
from inkwarp.operators import counting as K
from inkwarp.operators import networks as N
from inkwarp.operators import senses as G
from inkwarp.operators import summaries as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_weighted_order(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "A", 3)], "k int, c string, p int")
    assert rows(K.weighted_order(df, "k", "c", "p"), "k", "items") == [(1, "A; B")]


def test_merge_and_compare(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "term string, df long")
    b = spark.createDataFrame([("y", 2), ("z", 5)], "term string, df long")
    assert {tuple(r) for r in K.merged(a, b).collect()} == {("x", 3, None), ("y", 1, 2), ("z", 0, 5)}
    assert {tuple(r) for r in K.compared(a, b, ["term"]).collect()} == {("x", "left"), ("y", "both"), ("z", "right")}


def test_breakdown_and_occurrences(spark):
    df = spark.createDataFrame([("a", "x", '"p"; q; p'), ("a", None, "q")], "u string, v string, l string")
    assert {tuple(r) for r in K.breakdown(df, ["u", "v"]).collect()} == {("u", "a", 2), ("v", "x", 1), ("v", None, 1)}
    assert rows(K.occurrences(df, "l"), "term", "n") == [("p", 2), ("q", 2)]


def test_dice_and_links(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "ab cd ef"), (3, "ab")], "doc_id int, text string")
    p = K.postings(docs)
    v = K.document_frequency(p)
    d = N.dice(p, v)
    assert rows(d, "a", "b", "df12", "dice") == [("ab", "cd", 2, 0.8)]
    assert rows(N.links(d, v, 3, 1), "term", "other", "mi") == [("ab", "cd", 0.0), ("cd", "ab", 0.0)]


def test_components_and_closure(spark):
    nodes = spark.range(1, 9).toDF("node")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (7, 8), (8, 3)], "a long, b long")
    assert rows(N.components(nodes, edges), "node", "cluster") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 1), (8, 1)]
    tree = spark.createDataFrame([("dog", "canine"), ("canine", "animal"), ("cat", "animal"), ("animal", "thing"), ("dog", "pet"), ("pet", "animal")], "child string, parent string")
    up = {(r["node"], r["ancestor"]): r["depth"] for r in N.closure(tree).collect()}
    assert up["dog", "animal"] == 2 and up["dog", "thing"] == 3 and up["cat", "cat"] == 0
    words = spark.createDataFrame([("Dog", "dog"), ("Cat", "cat")], "word string, node string")
    top = [r["ancestor"] for r in N.common_terms(words, tree, 3).collect()]
    assert "animal" in top and "thing" not in top


def test_summary(spark):
    text = "The engine drives the large rotor of steel.\nIt is short.\nFIG. 2 shows the engine and all of its parts.\nThe rotor of the engine turns the wheel of the large engine."
    docs = spark.createDataFrame([(1, text, "features"), (2, None, "task"), (3, "", "task")], "doc_id int, text string, section string")
    w = docs.filter("doc_id = 1").select(F.inline(S.weighted(F.split("text", "\n"), F.col("section")))).collect()
    assert [(r["para"], r["weight"]) for r in w] == [(0, 3.0), (1, 3.0), (2, 1.5)]
    s = S.scores(docs).select("doc_id", S.best(F.col("scores"), F.lit(1)).alias("b")).collect()
    by = {r["doc_id"]: r["b"] for r in s}
    assert by[3] is None and 2 not in by and len(by[1]) == 1 and "short" not in by[1][0]["sentence"]
    fit = spark.range(1).select(S.fit_sentences(F.transform(F.array(*map(F.lit, ["A b c d e f g", "a b c d e f g", "A b", "Ends in a b c d e", "[ 0002 ] Also fit for it is this", "A b c d e f sub .", "A b c d e f later"])), lambda x: F.struct(x.alias("sentence")))).alias("f")).first()["f"]
    assert [x["sentence"] for x in fit] == ["A b c d e f g", "[ 0002 ] Also fit for it is this", "A b c d e f sub ."]


def test_buckets(spark):
    df = spark.range(100).select("id", F.lit(10).alias("n"))
    assert rows(K.size_buckets(df, "id", F.col("n"), 250), "id", "bucket") == [(i, i * 10 // 250) for i in range(100)]


def test_svd_goldens():
    assert np.allclose(C.singular_values(np.array([[2, 4], [1, 3], [0, 0], [0, 0]], float))[1], [5.465, 0.366], atol=1e-3)
    m = np.array([[(c / 4) ** (r / 5) if c or r else 1.0 for c in range(5)] for r in range(6)])
    u, s, v = C.singular_values(m)
    assert np.allclose(u * s @ v.T, m) and np.allclose(C.singular_values(m.T)[1], s)
    whole = np.array([[(c / 4) ** (r / 5) for c in range(5)] for r in range(6)])
    assert np.allclose(C.singular_values(whole)[1], [4.0143, 0.9803, 0.3522, 0.0209, 0.0004], atol=5e-5)
    assert np.allclose(np.outer(*C.eigen_trend(m)) + (u[:, 1:] * s[1:]) @ v[:, 1:].T, m)


def test_regression_golden(spark):
    df = spark.createDataFrame([(2.0, 1.0, 3.0, -1.0), (1.0, 1.0, 5.0, 2.0), (20.0, 1.0, 31.0, 0.0), (15.0, 1.0, 11.0, 2.0), (float("nan"), 1.0, 1.0, 1.0)], "y double, a double, b double, c double").replace(float("nan"), None)
    r = C.regression(df, "y", ["a", "b", "c"])
    assert np.allclose(r["theta"], [0.2950, 0.6723, 1.0688], atol=1e-4) and r["rsq"] == pytest.approx(0.808, abs=1e-3)
    assert np.allclose(r["errors"], [6.0512, 0.3278, 2.7954], atol=1e-4) and C.regression(df.limit(0), "y", ["a"])["theta"] is None


def fixture():
    sim = np.eye(5)
    d = np.array([[0, 0.5, 0.5, 0.5, 0.5], [0.5, 0, 0.7071, 0.7071, 1], [0.5, 0.7071, 0, 1, 0.7071], [0.5, 0.7071, 1, 0, 0.7071], [0.5, 1, 0.7071, 0.7071, 0]])
    return sim, d


def test_maps():
    _, d = fixture()
    points, values = C.classical_mds(d, 2)
    assert np.allclose(values, [0.5, 0.5, 0, 0, 0], atol=1e-3) and C.map_quality(d, points) == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(15, 4))
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    first = C.classical_mds(far, 2)[0]
    moved, stress = C.sammon(far, first)
    assert stress < C.sammon(far, first, rounds=0)[1]
    assert C.kruskal(far, first)[1] <= C.kruskal(far, first, rounds=1)[1] and np.array_equal(C.isotonic(np.array([1.0, 3, 2, 4])), [1, 2.5, 2.5, 4])
    with pytest.raises(ValueError):
        C.sammon(np.zeros((3, 3)), np.zeros((3, 2)))
    assert moved.shape == (15, 2)


def test_landmark_map_is_classical_for_few(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    at = np.stack(C.landmark_map(df, "id", "v").toPandas().sort_values("id")["at"])
    assert np.allclose(np.linalg.norm(at[:, None] - at[None], axis=2), np.linalg.norm(x[:, None] - x[None], axis=2))


def test_map_is_classical_beyond_a_few_hundred_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (600, 5)) * [4, 2, 1, 1, 1], rng.normal(0, 1, (3, 5)) + [0, 0, 0, 0, 90]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(5)
    at = np.stack(C.landmark_map(df, "id", "v").toPandas().sort_values("id")["at"])
    exact = C.classical_mds(np.linalg.norm(x[:, None] - x[None], axis=2), 2)[0]
    assert np.allclose(np.abs(at), np.abs(exact), atol=1e-6)


def test_similarity_and_complete_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 4) >= 0.8}
    monkeypatch.setattr(C, "BLOCK", 25)
    pairs = C.cosine_pairs(df, "id", "v", 0.8)
    assert {(r["i"], r["j"]) for r in pairs.collect()} == want
    nodes = df.select(F.col("id").alias("node"))
    merges = C.complete_link(nodes, pairs)
    # every merge by brute force over all pairs of clusters
    sims = {(r["i"], r["j"]): r["sim"] for r in pairs.collect()}
    clusters, steps = [{i} for i in range(60)], []
    while True:
        least = lambda a, b: min(sims.get((min(i, j), max(i, j)), 0) for i in a for j in b)
        best = max(((least(a, b), -min(a | b), -max(min(a), min(b)), a, b) for k, a in enumerate(clusters) for b in clusters[k + 1 :]), key=lambda x: x[:3])
        if best[0] <= 0:
            break
        steps.append((min(best[3] | best[4]), max(min(best[3]), min(best[4])), best[0]))
        clusters = [c for c in clusters if c not in best[3:]] + [best[3] | best[4]]
    assert sorted((r["left"], r["right"], r["sim"]) for r in merges.collect()) == sorted(steps)
    found = {r["node"]: r["cluster"] for r in C.cut_tree(nodes, merges, 0.8).collect()}
    assert {min(c): c for c in clusters} == {k: {i for i in found if found[i] == k} for k in set(found.values())}
    two = C.cut_tree(nodes, merges, 0.8, 2).collect()
    assert len({r["cluster"] for r in two}) == 2


def test_hubs_meet_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = {(int(i), int(k)) for i, k in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), strict=True)} | {(i, 99) for i in range(40)}
    df = spark.createDataFrame(list(data) + [(None, 1), (1, None)], "i int, k int")
    want = {}
    for i in range(40):
        for j in range(i + 1, 40):
            want[i, j] = sum((i, k) in data and (j, k) in data for k in range(100))
    monkeypatch.setattr(N, "HUB", 7)
    for least in (1, 2, 4):
        assert {(r["a"], r["b"]): r["n"] for r in N.shared(df, "i", "k", least).collect()} == {p: n for p, n in want.items() if n >= least}


def test_document_cosines(spark, monkeypatch):
    rng = np.random.default_rng(6)
    tf = rng.poisson(0.6, (20, 9))
    tf[:, 8] = 1  # in all documents
    df = spark.createDataFrame([(int(i), f"t{j}", int(tf[i, j])) for i, j in zip(*np.nonzero(tf), strict=True)], "doc_id int, term string, tf bigint")
    w = tf * np.log(20 / np.maximum((tf > 0).sum(axis=0), 1))
    u = w / np.maximum(np.linalg.norm(w, axis=1), 1e-12)[:, None]
    want = {(i, j): round(float(u[i] @ u[j]), 4) for i in range(20) for j in range(i + 1, 20) if round(float(u[i] @ u[j]), 4) >= 0.2}
    monkeypatch.setattr(N, "HUB", 5)
    found = {(r["a"], r["b"]): r["sim"] for r in N.similar(df, 0.2).collect()}
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), atol=1.1e-4)


def test_closure_of_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "child long, parent long")
    up = {(r["node"], r["ancestor"]): r["depth"] for r in N.closure(chain, chain.limit(0).select(F.col("child").alias("node")).union(spark.createDataFrame([(0,)], "node long"))).collect()}
    assert up == {(0, i): i for i in range(31)}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "child long, parent long")
    assert len(N.closure(ring).collect()) == 9


def test_collinear_regression_and_combinations(spark):
    df = spark.createDataFrame([(float(3 * i + 1), 1.0, float(i), float(2 * i)) for i in range(6)], "y double, a double, b double, c double")
    r = C.regression(df, "y", ["a", "b", "c"])
    assert r["theta"][0] == pytest.approx(1) and r["theta"][1] + 2 * r["theta"][2] == pytest.approx(3) and r["rsq"] == pytest.approx(1)
    two = C.regression(spark.createDataFrame([(float(y), 1.0, float(x)) for x, y in enumerate([1, 2, 2, 5])], "y double, a double, b double"), "y", ["a", "b"])
    value, error = C.combination(two, [1.0, 2.0])
    assert value == pytest.approx(two["theta"][0] + 2 * two["theta"][1]) and error > 0


def test_hot_and_odd_vectors_in_the_similarity_join(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 10)
    rng = np.random.default_rng(8)
    x = [[1.0, 0.0, 0.0]] * 45 + rng.normal(size=(40, 3)).tolist() + [[0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(200, [1.0]), (201, None)], "id long, v array<double>")
    u = np.array(x) / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    want = {(i, j) for i in range(86) for j in range(i + 1, 86) if round(float(u[i] @ u[j]), 4) >= 0.9}
    found = [(r["i"], r["j"]) for r in C.cosine_pairs(df, "id", "v", 0.9).collect()]
    assert set(found) == want and len(found) == len(want) and not C.cosine_pairs(df.limit(0), "id", "v", 0.9).count()


def test_singular_values_of_long_tables(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(50, 4)) * [1, 1, 1, 1e-6]
    cells = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i in range(50) for j in range(4)], "r int, c string, v double").repartition(5)
    s, v = C.tall_svd(cells, "r", "c", "v", ["c0", "c1", "c2", "c3"])
    u, s2, v2 = C.singular_values(m)
    assert np.allclose(s, s2, rtol=1e-9) and np.allclose(np.abs(v), np.abs(v2), atol=1e-6)


def test_journal_names_meet_by_their_first_letters(spark):
    full = ["ACOUSTICAL PHYSICS", "ACTA ACUSTICA UNITED WITH ACUSTICA", "THE JOURNAL OF X", "4OR-A QUARTERLY JOURNAL OPERATIONS RESEARCH", "PHYSICS OF FLUIDS", "A", ""]
    short = ["ACOUST PHYS+", "ACTA ACUST UNITED AC", "J X", "4OR-Q J OPER RES", "PHYS FLUIDS", "PHYS", "A", "", "X"]
    pairs = K.matched_names(spark.createDataFrame([(x,) for x in short], "short string"), spark.createDataFrame([(x,) for x in full], "full string"))
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in short for b in full if T.journal_match(a, b)}


def test_section_summaries_by_hand(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["engine", "rotor", "cost", "wheel", "steel", "problem", "large"]
    rows, want = [], {}
    for i in range(12):
        section = ("task", "abstract", "features", "application")[i % 4]
        paras = [" ".join(" ".join(["The", *rng.choice(vocabulary, 6)]) + "." for _ in range(rng.integers(1, 12))) for _ in range(7)] + ["FIG. 1 shows a lot of things to us."]
        rows.append((i, section, "Rotor engine", paras))
        tf = Counter(re.findall("[a-z]+", " ".join([*paras, "Rotor engine"]).lower()))
        if section in ("task", "features"):
            tf.update(S.CLUES)
        sents = [(p, j, x.strip()) for p, text in enumerate(paras[:7]) for j, x in enumerate(re.findall(r"[^.!?]+[.!?]*", text))]
        weight = [(1.5 if j == 0 and section != "abstract" else 1.0) * (2 if p < 2 else 4 if p == 5 or p == 6 and section == "task" else 1) for p, j, _ in sents]
        if section in ("task", "features") and len(sents) > 50:
            low, out = int(0.3 * len(sents)), int(0.6 * len(sents))
            del sents[low : low + out], weight[low : low + out]
        score = []
        for (_, _, x), w in zip(sents, weight, strict=True):
            n = {t: x.lower().count(t) for t in tf}
            score.append(round(sum(k * (0.5 + w * tf[t] / max(tf.values())) for t, k in n.items()) / max(1, sum(n.values())) ** 0.375, 4))
        top = sorted(sorted(range(len(sents)), key=lambda k: (-score[k], k))[: 2 if section == "task" else 3])
        want[i] = [sents[k][2] for k in top]
    df = spark.createDataFrame(rows, "doc_id int, section string, title string, paras array<string>")
    assert {r["doc_id"]: r["summary"] for r in S.section_summaries(df, 3, {"task": 2}).collect()} == want


def test_rings_of_senses(spark):
    pointer = spark.createDataFrame([("a", "@", "b"), ("b", "~", "c"), ("c", "%p", "d"), ("x", "@", "y"), ("d", "!", "x")], "src string, ptr string, dst string")
    one = lambda v: spark.createDataFrame([(v,)], "synset string")
    assert [tuple(r) for r in G.global_distance(pointer, one("d"), one("a")).collect()] == [(3, "a : b|hyper : c|hypo : d|mero")]
    assert not G.global_distance(pointer, one("d"), one("a"), 1).count() and not G.global_distance(pointer, one("x"), one("a")).count()
    assert [tuple(r) for r in G.global_distance(pointer, one("a"), one("a")).collect()] == [(0, "a")]
    form = spark.createDataFrame([("p", "n", "q"), ("q", "n", "p"), ("r", "n", "s")], "word string, pos string, base string")
    sense = spark.createDataFrame([("s", "n", 2, "s2"), ("s", "n", 1, "s1")], "word string, pos string, sense_no int, synset string")
    words = spark.createDataFrame([("r", "n"), ("p", "n"), ("s", "n")], "word string, pos string")
    assert rows(G.lookup(words, sense, form), "word", "synset") == [("r", "s1"), ("r", "s2"), ("s", "s1"), ("s", "s2")]
    assert rows(G.lookup(words, sense, form, 1), "word", "synset") == [("r", "s1"), ("s", "s1")]


def test_stages_are_read_where_they_are(spark, tmp_path):
    p = spark.createDataFrame([(i, t, 2) for i in range(8) for t in (["x", "y"] if i < 4 else ["z", "w"])], "doc_id bigint, term string, tf bigint")
    found = C.cluster_documents(p, str(tmp_path), 0.5)
    assert rows(found, "doc_id", "cluster", "title") == [(i, 0 if i < 4 else 4, "x; y" if i < 4 else "w; z") for i in range(8)]
    other = C.cluster_documents(p.withColumn("term", F.col("doc_id").cast("string")), str(tmp_path), 0.5)  # the stages hold
    assert rows(other, "doc_id", "cluster") == rows(found, "doc_id", "cluster")
    anew = C.cluster_documents(p.withColumn("term", F.col("doc_id").cast("string")), str(tmp_path), 0.5, again="index")
    assert rows(anew, "doc_id", "cluster") == [(i, i) for i in range(8)]
