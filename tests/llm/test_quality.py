import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import quality

DATA = "/root/testdata/sf0.01"


def test_statistics_by_hand():
    texts = pa.array(["The the CAT!! sat. | 42 ***", "", None, "é" * 300_000 + " x"])
    s = quality.statistics_of(texts)
    assert np.expm1(s["log_words"]).round().tolist() == [7, 0, 0, 2]
    assert s["stutter"].tolist()[0] == pytest.approx(1 / 7) and s["distinct"].tolist()[0] == pytest.approx(6 / 7)
    assert s["shouts"][0] == pytest.approx(2 / 7) and s["symbols"][0] == pytest.approx(3 / 7) and s["bars"][0] == pytest.approx(1 / 7)
    assert s["upper"][0] == pytest.approx(4 / 12) and s["longest"][3] == pytest.approx(np.log1p(600_000))
    assert all(s[name][1] == s[name][2] for name in quality.STATISTICS)


def test_paths_of_a_tree_become_rules():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    rules = quality.tree_rules(text, ("a", "b"))
    assert [r.bounds for r in rules] == [(("a", -np.inf, 0.5),), (("a", -np.inf, 0.5), ("b", 2.0, np.inf)), (("a", -np.inf, 0.5), ("b", -np.inf, 2.0)), (("a", 0.5, np.inf),)]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels)
    assert got.count() == docs.count()
    judged = got.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert judged > 0.93
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 50_000, "x"), (3, "a", "x"), (None, "a", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), one).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_scores_against_the_rules_one_by_one(spark):
    """The compiled expression equals the sum over the model's rules, each tried on each text's statistics."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.text_statistics(docs).cache()
    model = quality.fit_rules(stats.join(labels.where(~quality.held_out(F.col("doc_id"))), "doc_id").orderBy("doc_id"))
    assert 5 < len(model.weights) and all(rule.bounds for rule, _ in model.weights)
    got = {r.doc_id: r.score for r in stats.select("doc_id", model.score().alias("score")).collect()}
    texts = docs.select("doc_id", "text").toPandas()
    own = quality.statistics_of(pa.array(texts.text, pa.string()))
    for i, doc in enumerate(texts.doc_id):
        total = model.intercept + sum(w for rule, w in model.weights if all(low < own[name][i] <= high for name, low, high in rule.bounds))
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
    assert len(got) == len(texts)
