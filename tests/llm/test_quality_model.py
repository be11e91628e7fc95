"""Operator 4: held-out decisions, gradient, ordered thresholds, strange rows."""

import numpy as np
from pyspark.sql import functions as F

from cases import documents, edge_docs, edge_rows, empty_docs
from tagwright.llm.quality_model import classify_quality, fit_cumulative, graded, grade_quality, train_quality

SF = "/root/testdata/sf0.1"


def test_held_out_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = classify_quality(docs, labels).where("held_out").join(graded(labels).withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i"))
    rows = got.select("grade", "kept", "p_above_lowest", "p_top", "expected_grade").collect()
    share = lambda g: np.mean([r["kept"] for r in rows if r["grade"] == g])
    # 4,000 rated texts, one in ten toxic: few to learn toxic words from
    assert share(2) >= 0.98 and share(0) <= 0.2 and share(1) <= 0.15
    for r in rows:
        assert r["p_top"] <= r["p_above_lowest"] and abs(r["expected_grade"] - r["p_top"] - r["p_above_lowest"]) < 1e-6


def test_recovers_an_ordinal_model():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=30) * 2
    rows, grades = [], []
    for _ in range(4000):
        at = rng.choice(30, 6, replace=False)
        s = weights[at].sum()
        u = rng.logistic()
        rows.append((at.astype(np.int32), np.ones(6, np.float32)))
        grades.append(int(s + u > -1) + int(s + u > 1.5))
    w, t = fit_cumulative(rows, np.array(grades), 3, dims=30, penalty=1e-6, steps=200)
    assert t[0] < t[1]
    # six of the weights are added up, so a common shift is free
    assert np.corrcoef(w, weights)[0, 1] > 0.99
    assert abs((t[1] - t[0]) - 2.5) < 0.4


def test_edge_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (11, 0, 0), (12, 1, 1), (12, 1, 0), (20, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = classify_quality(edge_docs(spark), labels)
    assert got.count() == len(edge_rows()) and {"key", "word"} <= set(got.columns)
    assert got.where("p_top IS NULL OR p_top < 0 OR p_top > 1").count() == 0


def test_nothing_to_learn(spark):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    assert classify_quality(docs, labels).where("NOT kept OR expected_grade <> 2").count() == 0
    assert classify_quality(docs, labels.limit(0)).where("expected_grade <> 0").count() == 0
    assert classify_quality(empty_docs(spark), labels).collect() == []
    other = spark.createDataFrame([(900, 1, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    assert classify_quality(docs, other).count() == len(edge_rows())


def test_same_model_whatever_the_partitions(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = train_quality(docs, graded(labels))
    b = train_quality(docs.repartition(9), graded(labels))
    assert np.allclose(a.weights, b.weights, atol=1e-5) and np.allclose(a.thresholds, b.thresholds)
    assert grade_quality(docs, a, keep=["doc_id"]).columns == ["doc_id", "expected_grade", "p_above_lowest", "p_top", "kept"]
