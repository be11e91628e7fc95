"""Model operators against brute force on a small fixture."""

import numpy as np
from pyspark.sql import functions as F

from tagwright.operators import classify as CL
from tagwright.operators import features as FE
from tagwright.operators import paths as PA
from tagwright.operators import split as SP

SF = "/root/testdata/sf0.001"


def small_features(spark):
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(lab, "doc_id")
    d = d.select("doc_id", "quality", F.col("quality").cast("double").alias("label"),
                 FE.tokens(F.col("text")).alias("tokens"))
    vocab = FE.vocabulary_list(FE.vocabulary(d, "tokens", 200))
    feats = FE.vectorizer(vocab).transform(d)
    return SP.stratified_folds(feats, "doc_id", "quality", 92, 3).cache(), vocab


def blocks_of(data, label="label"):
    return PA.feature_blocks(data, label=label, key="doc_id")


def test_all_models_equal_single_fits(spark):
    """Every fold and penalty of one batched run against Spark's own fit of its rows."""
    data, vocab = small_features(spark)
    cs = [10.0, 40.0]
    paths = PA.fit_paths(blocks_of(data), len(vocab), cs, [0, 1, PA.ALL], max_iter=150, tol=1e-6)
    assert paths.finished.sum() >= 3 and paths.violations(1e-2).sum() == 0
    for f in (0, PA.ALL):
        rows = data.where(F.col("fold") != f).cache()
        n = rows.count()
        for i, c in enumerate(cs):
            b = [0, 1, PA.ALL].index(f) * len(cs) + i
            single = CL.l1_logistic(c / n, max_iter=500, tol=1e-10).fit(rows)
            assert np.abs(paths.weights[:-1, b] - single.coefficients.toArray()).max() < 1e-4
            assert abs(paths.weights[-1, b] - single.intercept) < 1e-3
        rows.unpersist()


def test_partitions_and_trees_of_sums_do_not_matter(spark, monkeypatch):
    data, vocab = small_features(spark)
    one = PA.fit_paths(blocks_of(data.coalesce(1)), len(vocab), [1.0, 10.0], [0, PA.ALL], max_iter=10)
    monkeypatch.setattr(PA, "DIRECT", 2)
    monkeypatch.setattr(PA, "SLICE", 100)
    monkeypatch.setattr(PA, "BLOCK", 7)
    many = PA.fit_paths(blocks_of(data).repartition(9), len(vocab), [1.0, 10.0], [0, PA.ALL], max_iter=10)
    assert np.allclose(one.weights, many.weights, atol=1e-6)


def test_grid_search_scores_are_those_of_the_models(spark):
    data, vocab = small_features(spark)
    cs = [0.1, 1.0, 100.0]
    blocks = blocks_of(data)
    paths, scores, best = PA.grid_search(blocks, len(vocab), cs, 3, max_iter=10)
    got = {(r["i"], r["fold"]): (r["n"], r["correct"]) for r in scores.collect()}
    terms = FE.document_term_long(data, "doc_id", spark.createDataFrame([(t,) for t in vocab], "term string"))
    means = []
    for i in range(3):
        share = []
        for f in range(3):
            w = PA.weights_table(spark, paths.weights[:, f * 3 + i], vocab)
            m = PA.margins(terms, data.where(F.col("fold") == f).select("doc_id", "quality"), "doc_id", w).collect()
            right = sum((r["margin"] > 0) == r["quality"] for r in m)
            assert got[i, f] == (len(m), right)
            share.append(right / len(m))
        means.append(round(sum(share) / 3, 12))
    assert best == means.index(max(means))


def test_optimality_check_sees_a_changed_weight(spark):
    data, vocab = small_features(spark)
    w = PA.fit_paths(blocks_of(data), len(vocab), [20.0], [PA.ALL], max_iter=100, tol=1e-5).weights[:, 0]
    terms = FE.document_term_long(data, "doc_id", spark.createDataFrame([(t,) for t in vocab], "term string"))
    rows = data.select("doc_id", "quality")

    def bad(weights):
        return PA.optimality_violations(terms, rows, "doc_id", "quality", PA.weights_table(spark, weights, vocab), 20.0)
    assert bad(w) == 0
    changed = w.copy()
    changed[int(np.abs(w[:-1]).argmax())] += 0.5
    assert bad(changed) > 0


def test_three_classes_in_one_run(spark):
    data, vocab = small_features(spark)
    data = data.withColumn("grade", (F.col("doc_id") % 3).cast("double"))
    blocks = blocks_of(data, "grade")
    both = PA.fit_paths(blocks, len(vocab), [10.0], [PA.ALL], max_iter=50, classes=[0.0, 1.0, 2.0])
    for k in range(3):
        own = data.withColumn("own", (F.col("grade") == k).cast("double"))
        single = PA.fit_paths(blocks_of(own, "own"), len(vocab), [10.0], [PA.ALL], max_iter=50)
        assert np.allclose(both.weights[:, k], single.weights[:, 0], atol=1e-3)


def test_no_rows_one_class_and_nulls(spark):
    data, vocab = small_features(spark)
    none = PA.fit_paths(blocks_of(data.limit(0)), len(vocab), [1.0], [0, PA.ALL])
    assert not none.weights.any()
    same = PA.fit_paths(blocks_of(data.withColumn("label", F.lit(1.0))), len(vocab), [1.0], [PA.ALL])
    assert not same.weights[:-1].any() and same.weights[-1, 0] > 10
    nulls = data.withColumn("label", F.when(F.col("doc_id") % 2 == 0, F.col("label")))
    a = PA.fit_paths(blocks_of(nulls), len(vocab), [1.0], [PA.ALL], max_iter=8).weights
    b = PA.fit_paths(blocks_of(data.where("doc_id % 2 = 0")), len(vocab), [1.0], [PA.ALL], max_iter=8).weights
    assert np.allclose(a, b)


def test_strong_penalty_zeroes_every_weight(spark):
    data, vocab = small_features(spark)
    w = PA.fit_paths(blocks_of(data), len(vocab), [1e6], [PA.ALL], max_iter=50).weights[:, 0]
    assert not w[:-1].any()
    top = CL.top_coefficients(PA.weights_table(spark, w, vocab), 5)
    assert top.count() == 10 and top.where("weight <> 0").count() == 0


def test_folds_are_stratified(spark):
    data, _ = small_features(spark)
    per = {(r.quality, r.fold): r.n for r in data.groupBy("quality", "fold").agg(
        F.count("*").alias("n")).collect()}
    for q in {k[0] for k in per}:
        sizes = [per.get((q, f), 0) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_bench_fits_anew_in_each_timed_run():
    import sys
    from pathlib import Path
    from unittest.mock import MagicMock

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import bench
    from tagwright.plans import model_queries

    kept = dict(model_queries._FITS)
    try:
        seen = []

        def query(spark, sf):
            seen.append(dict(model_queries._FITS))
            model_queries._FITS["app", sf] = "fitted"
            return MagicMock()
        assert bench.timed(query, None, "sf") >= 0 and bench.timed(query, None, "sf") >= 0
        assert seen == [{}, {}]
    finally:
        model_queries._FITS.clear()
        model_queries._FITS.update(kept)


def test_driver_gets_one_copy_of_the_sums(spark, monkeypatch):
    """Whatever the number of tasks, and few models as many."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), i % 3, Vectors.sparse(50, {int(j): float(j % 4 + 1) for j in rng.choice(50, 5, False)})) for i in range(90)]
    data = spark.createDataFrame(rows, ["doc_id", "label", "fold", "features"])
    blocks = PA.feature_blocks(data.coalesce(1), key="doc_id").repartition(5)
    got, real = [], Classic.toArrow

    def counted(self):
        got.append(real(self))
        return got[-1]
    monkeypatch.setattr(Classic, "toArrow", counted)
    size = 51 * 2000
    total = PA._summed(blocks, (size, 50), lambda y, f, x: np.tile(x.sums(1), 2000))
    assert sum(len(b) for t in got for b in t["numbers"].to_pylist()) == 8 * size
    dense = np.array([r[3].toArray() for r in rows])
    assert np.allclose(total[:51], [*dense.sum(axis=0), 90])


def test_sparse_and_dense_products_agree():
    import numpy as np
    rng = np.random.default_rng(4)
    ends, indices = np.array([0, 2, 2, 5], "<i4"), np.array([1, 4, 0, 2, 5], "<i4")
    x = PA.Features(ends, indices, rng.normal(size=5), 6)
    w, e = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    assert np.allclose(x.times(w), x.dense() @ w) and np.allclose(x.back(e), x.dense().T @ e)
    assert np.allclose(x.sums(1), x.dense().sum(axis=0)) and np.allclose(x.sums(2), (x.dense() ** 2).sum(axis=0))
    assert x.times(w[:, :0]).shape == (3, 0) and x.back(e[:, :0]).shape == (7, 0)


def long_texts(spark):
    """Counts of very different size, and answers that they hardly tell."""
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    out = []
    for i in range(1500):
        at = np.sort(rng.choice(40, int(rng.integers(2, 25)), False))
        long = 10.0 ** rng.uniform(0, 1.5) if i % 20 == 0 else 1.0
        out.append((i, float(rng.random() < 0.8), i % 3, Vectors.sparse(40, at.tolist(), (long * rng.integers(1, 4, len(at))).tolist())))
    return spark.createDataFrame(out, ["doc_id", "label", "fold", "features"])


def test_few_models_need_few_passes(spark, monkeypatch):
    """Among long texts, whose answers turn in one step, the end test takes a few passes
    (by L-BFGS over 70); rows held by the tasks or summed up in them do not matter."""
    blocks = blocks_of(long_texts(spark))
    found = []
    for held in (PA.ROWS_HELD, 0):
        monkeypatch.setattr(PA, "ROWS_HELD", held)
        paths = PA.fit_paths(blocks, 40, [1.0], [0, PA.ALL], max_iter=1000, tol=1e-5, slack=0.01)
        assert paths.finished.all() and paths.violations(0.02).sum() == 0 and paths.steps <= 20
        found.append(paths.weights)
    assert np.allclose(*found, atol=1e-4)


def test_newton_and_lbfgs_end_at_the_same_weights(spark, monkeypatch):
    data, vocab = small_features(spark)
    blocks = blocks_of(data)
    newton = PA.fit_paths(blocks, len(vocab), [10.0, 40.0], [0, PA.ALL], max_iter=500, tol=1e-6)
    monkeypatch.setattr(PA, "NEWTON", 0)
    monkeypatch.setattr(PA, "HELD", 0)
    lbfgs = PA.fit_paths(blocks, len(vocab), [10.0, 40.0], [0, PA.ALL], max_iter=500, tol=1e-6)
    assert newton.finished.all() and newton.steps < lbfgs.steps
    assert np.allclose(newton.weights[:-1], lbfgs.weights[:-1], atol=1e-3)


def test_curvature_is_that_of_the_loss(spark, monkeypatch):
    """Summed over tasks, for each model's own rows; where a margin has turned, at least what it met."""
    data = long_texts(spark).limit(90)
    monkeypatch.setattr(PA, "BLOCK", 7)
    blocks = blocks_of(data).repartition(3)
    rng = np.random.default_rng(6)
    now, own, deviation = rng.normal(size=(41, 2)) / 10, np.array([0, PA.ALL]), rng.uniform(1, 2, 41)
    x = np.array([[*r["features"].toArray(), 1] for r in data.collect()])
    f = np.array([r["fold"] for r in data.collect()])
    for b, h in enumerate(PA._curvatures(blocks, now, now, own, deviation, 3)):
        p, mine = 1 / (1 + np.exp(-np.clip(x @ (now[:, b] / deviation), -500, 500))), f != own[b]
        want = ((x / deviation).T * (p * (1 - p) * mine)) @ (x / deviation) / mine.sum()
        assert np.allclose(h, want[np.triu_indices(41)], rtol=1e-3, atol=1e-4 * np.abs(want).max())
    one = np.array([[1.0]])
    assert PA._bent(one, np.zeros(1, int), 50 * one, -50 * one, np.array([1]))[0, 0] == 1 / 100
