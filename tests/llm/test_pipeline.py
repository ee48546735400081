"""Stages of the pipeline, each against what its operator says of the stage's own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from codonflow.llm.decontaminate import find_leaks
from codonflow.llm.jaccard_join import jaccard_components
from codonflow.llm.mixing import mixed, word_count
from codonflow.llm.quality import classify
from codonflow.llm.shared import table


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf, "documents"), []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(stages):
    assert [s[0] for s in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "source mixing", "token ids"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, sf, stages):
    _, before, after = stages[0]
    assert ids(after) == ids(classify(before, table(spark, sf, "labels")).where("predicted = 1")) and 0 < after.count() < before.count()


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    assert ids(after) == ids(jaccard_components(before).where("component_id = doc_id"))


def test_decontamination(spark, sf, stages):
    _, before, after = stages[2]
    leaked = {r.doc_id for r in find_leaks(before, table(spark, sf, "benchmark")).collect()}
    assert leaked and ids(after) == [i for i in ids(before) if i not in leaked]


def test_mix(stages):
    _, before, after = stages[3]
    expected = {r.doc_id: r.taken for r in mixed(before).where("taken > 0").collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    assert got == expected


def test_tokens(stages):
    _, before, after = stages[4]
    assert ids(after) == ids(before)
    rows = sorted(after.collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_run(spark, sf, stages):
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns with the names that operators use; and no rows at all."""
    good = "the quick brown fox jumps over the lazy dog and runs far away from here today "
    rows = [(k, good + " ".join(f"w{k}x{j}" for j in range(30)), "en", "a" if k % 3 else "b", 9) for k in range(30)]
    rows += [rows[3], rows[3], (40, None, None, None, None), (41, "", "en", "a", 0), (42, " \n ", "en", "a", 3), (None, good * 3, None, None, None), (None, None, None, None, None), (43, good + " ".join(f"l{j}" for j in range(50_000)), "en", "c", 1)]
    item = "what is the capital of the land of the free\nit is the city on the hill by the sea"
    rows.append((44, "see: " + item + " and more", "en", "a", 5))
    clash = "size long, score double, key string, n long, rank int, component_id long, taken long, at long, start long, item_id long"
    full = [(*r, 1, 0.5, "k", 2, 3, 4, 5, 6, 7, 8) for r in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clash}"
    for name, data in (("some", full), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, 0, None), (41, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        df = table(spark, folder, "documents")
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, df, folder).write.parquet(f"{folder}/out{k}")
            after = spark.read.parquet(f"{folder}/out{k}")
            if k < 4:
                assert after.columns == df.columns
            df = after
            if name == "none":
                assert df.count() == 0
            elif k == 1:  # equal rows are one; those without words all stay
                assert ids(df.where("doc_id is not null")) == [*range(30), 40, 41, 42, 43, 44]
            elif k == 2:
                assert 44 not in ids(df.where("doc_id is not null"))


def test_shuffles_of_stages_go_with_them(spark, sf):
    """They stayed beside those of later stages until the driver collected garbage."""
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in folders for _, _, own in os.walk(d) for f in own if f.startswith("shuffle_") and f.endswith(".data")}
    before = shuffled()
    assert P.run(spark, sf).count() > 0
    left = shuffled() - before
    assert len({f.split("_")[1] for f in left}) <= 1, left  # that of the count
