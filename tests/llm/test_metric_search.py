"""Operator 13 against every pair."""

import math
import random

import numpy as np
import pytest

from tagwright.llm import metric_search as M


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every=100, k=10):
    points = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (q, x) in enumerate(points):
        if q is None or q % every:
            continue
        found = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(points) if a != b]
        out += [(q, r, None if none else i, max(-2 ** 63, min(2 ** 63 - 1, -s)))
                for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(7, i, v, "z") for i, v in rows], f"uid long, vec_id long, embedding array<{kind}>, point string")
    return sorted((tuple(r) for r in M.top_matches(df, **options).collect()), key=repr)


def f4(v):
    return [float(np.float32(x)) for x in v]


def clusters(rng, n, dims=8, groups=12, spread=0.05):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [f4(x + rng.gauss(0, spread) for x in rng.choice(middles)) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(512, 4096), (16, 40)])
def test_clusters_and_ties(spark, monkeypatch, sizes):
    """Few and many pages and leaves; a third of the rows are copies of one vector."""
    monkeypatch.setattr(M, "PAGE", sizes[0])
    monkeypatch.setattr(M, "LEAVES", sizes[1])
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = random.Random(4)
    vectors = clusters(rng, 800) + [[0.25] * 8] * 400 + [[0.0] * 8] * 5
    ids = list(range(len(vectors)))
    rng.shuffle(ids)
    rows = list(zip(ids, vectors))
    assert found(spark, rows, every=20) == brute(rows, every=20)


def test_strained_rows(spark):
    rng = random.Random(8)
    rows = list(enumerate(clusters(rng, 60, 4)))
    rows += [(100, [0.5, 0.5, 0.5, 0.5])] * 3 + [(None, [9.0, 9.0, 9.0, 9.0])] * 2     # repeated rows, null ids
    rows += [(200, None), (300, [1.0, None, 1.0, 1.0]), (400, [float("nan")] * 4), (500, [float("inf")] * 4)]
    rows += [(600, []), (700, [1.0]), (-800, [0.1, -0.1]), (800, [3e38] * 4), (801, [-3e38] * 4), (802, [2e6, 1e-3, 0.0, 7.0])]
    width = max(len(v) for _, v in rows if v is not None)
    padded = [(i, v + [0.0] * (width - len(v)) if usable(v) else v) for i, v in rows]
    got = found(spark, [(i, v if not usable(v) else f4(v)) for i, v in rows])
    assert {r[:3] for r in got if r[0] not in (800,)} == {r[:3] for r in brute([(i, v if not usable(v) else f4(v)) for i, v in padded])
                                                         if r[0] not in (800,)}
    assert len([r for r in got if r[0] == 800]) == 10


def test_large_whole_numbers(spark):
    """Products that doubles do not hold exactly."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2 ** 40, 2 ** 40)) / 1024 for _ in range(3)]) for i in range(300)]
    assert found(spark, rows, "double") == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(100, [1.0])], [(100, None)], [(100, []), (101, [])]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_pages_are_left_out():
    """Triangle bounds spare pages and points of clustered vectors, and stay above every score."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 8)) * 500
    x = np.floor(middles[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 5)
    tree = M.Tree(x, 40)
    leaf, apart = tree.descend(x)
    q, q_norm = x[:50], M.norms(x[:50])
    compared = 0
    for c in range(len(tree.leaf_pivots)):
        own = np.flatnonzero(leaf == c)
        if not len(own):
            continue
        d = M.distances(q, tree.leaf_pivots[c][None])[:, 0]
        scores = q @ x[own].T
        assert (M.bound(q_norm[:, None], d[:, None], apart[own], apart[own], M.norms(x[own])) >= scores).all()
        kth = np.sort(q @ x.T, axis=1)[:, -10]
        compared += (M.bound(q_norm, d, apart[own].min(), apart[own].max(), M.norms(x[own]).max()) >= kth).sum() * len(own)
    assert compared < 0.5 * len(q) * len(x)
