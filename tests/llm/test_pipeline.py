"""The corpus pipeline, stage by stage against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from inkwarp.llm import jaccard, mixing, packing, pii, quality

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs, found = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, D).write.parquet(path)
        after = spark.read.parquet(path)
        found.append((docs, after))
        docs = after
    return found


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_quality_rejects_what_the_forest_rejects(spark, stages):
    before, after = stages[0]
    forest = quality.train(before, spark.read.parquet(f"{D}/labels.parquet"))
    texts = before.toPandas()
    x = quality.features(pa.array(texts.text))
    good = (forest.score(x) >= quality.THRESHOLD) & (x[:, 0] > 0)
    assert set(after.toPandas().doc_id) == set(texts.doc_id[good]) and 0 < good.mean() < 1


def test_one_of_each_group_stays(stages):
    before, after = (x.toPandas().set_index("doc_id").text for x in stages[1])
    words = re.compile(r"[^\W_]+")

    def grams(t):
        w = words.findall(t.lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets = {i: grams(t) for i, t in before.items()}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert set(after.index) == {i for i in ids if root(i) == i} and len(after) < len(before)


def test_surrogates_replace_and_clean_documents_stay(stages):
    before, after = (x.toPandas().set_index("doc_id").text for x in stages[2])
    assert len(before) == len(after)
    changed = 0
    for i, t in before.items():
        entities = pii.find(t)
        if not entities:
            assert after[i] == t
        for low, high, _, _ in entities:
            changed += 1
            assert t[low:high] not in after[i]
    assert changed


def test_mix_meets_budgets(stages):
    before, after = (x.toPandas() for x in stages[3])
    n = lambda t: t.assign(n=t.text.str.split().str.len()).groupby("source").n.sum()
    have, got = n(before), n(after)
    budget = mixing.budgets({k: int(v) for k, v in have.items()})
    lengths = before.assign(n=before.text.str.split().str.len()).query("n > 0")
    for s, b in budget.items():
        of = Counter(lengths[lengths.source == s].n)
        sums = 1
        for length, count in of.items():  # every sum of lengths, by brute force
            for _ in range(count):
                sums |= sums << int(length)
        assert got[s] == (sums & (1 << b + 1) - 1).bit_length() - 1
    assert set(after.doc_id) <= set(before.doc_id)


def test_packing_places_what_came(stages):
    before, after = (x.toPandas() for x in stages[4])
    want = Counter({int(i): len(t.split()) for i, t in zip(before.doc_id, before.text, strict=True)})
    assert Counter({int(i): int(v) for i, v in after.groupby("doc_id").n_tokens.sum().items()}) == want
    assert (after.groupby("pack_id").n_tokens.sum() <= packing.CONTEXT).all()
    assert np.all(after.sort_values(["pack_id", "pack_offset"]).groupby("pack_id").pack_offset.first() == 0)


def test_run_is_its_stages(spark, stages):
    a, b = cp.run(spark, D).toPandas(), stages[-1][1].toPandas()
    key = list(b.columns)
    assert a.sort_values(key).values.tolist() == b.sort_values(key).values.tolist()


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, record int, row string, mix_hash bigint"
    a = "A plain sentence that says a thing or two about the weather of the day."
    rows = [(1, a, "en", "s", 70, 1, "r", 1)] * 2 + [(2, a, None, None, None, None, None, None), (3, None, None, None, None, None, None, None), (4, "", "en", "s", 0, 1, "r", 1), (None, a + " More of it.", None, "s", 1, 1, "r", 1), (5, "word other thing " * 20_000, "en", "t", 1, 1, "r", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns and out.count() <= table.count()
        packed = cp.STAGES[-1][1](spark, table, str(tmp_path)).toPandas()
        want = Counter()
        for i, t, *_ in table.collect():
            want[-1 if i is None else i] += len((t or "").split())
        assert Counter(packed.fillna({"doc_id": -1}).astype({"doc_id": int}).groupby("doc_id").n_tokens.sum().to_dict()) == +want


def test_only_the_last_result_stays(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    found = cp.run(spark, D)
    new = [x for x in os.listdir(folder) if x.startswith("pipeline-") and x not in before]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["4-packing"] and found.count()


def test_near_duplicates_of_a_large_family_cross_in_bounded_batches(spark, monkeypatch):
    matches = jaccard._matches

    def bounded(t, most):
        run = matches(t, most)

        def checked(batches):
            for batch in run(batches):
                if batch.nbytes > 20 << 20:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return checked

    monkeypatch.setattr(jaccard, "_matches", bounded)
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(1, 1801).select(F.col("id").alias("doc_id"), F.concat(F.lit(words + " end"), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(5000, "quite another text with words of its own")], docs.schema))
    assert sorted(r["doc_id"] for r in cp.distinct(spark, docs, "").collect()) == [1, 5000]
