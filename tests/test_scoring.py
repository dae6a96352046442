"""Directions of most variance against numpy, for narrow, wide and degenerate rows."""

import numpy as np
import pytest

from conftest import DATA
from emberlog.operators import scoring as sc


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(5)


def exact(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


@pytest.mark.parametrize("n, d, block, blocks", [(80, 7, 64, 8), (120, 90, 8, 8), (150, 100, 10, 4), (30, 120, 16, 8)])
def test_directions_span_the_same_space(spark, monkeypatch, n, d, block, blocks):
    """Narrow rows in one pass, wide ones by blocks, with condensing, and fewer rows than dimensions."""
    monkeypatch.setattr(sc, "BLOCK", block)
    monkeypatch.setattr(sc, "BLOCKS", blocks)
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d)) * np.linspace(3, 1, d) + rng.normal(size=d)
    df, k = frame(spark, x), 4
    mean, _, count = sc.vector_stats(df, "x")
    found, values = sc.leading_directions(df, "x", mean, count, k)
    want, space = exact(x, k)
    assert np.allclose(values, want, rtol=1e-8)
    assert np.allclose(found @ found.T, space @ space.T, atol=1e-7)
    assert np.allclose(found.T @ found, np.eye(k), atol=1e-9)


def test_directions_of_rows_of_low_rank(spark, monkeypatch):
    """Rows within three dimensions of sixty: the search ends when nothing new is left."""
    monkeypatch.setattr(sc, "BLOCK", 6)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 60))
    model = sc.Reconstruction.fit(frame(spark, x), "x", 5, 0.999999)
    assert model.directions.shape[1] <= 3
    df = frame(spark, x)
    assert max(r[0] for r in df.select(sc.Reconstruction.fit(df, "x", 5).error(sc.F.col("x"))).collect()) == 0.0


def test_directions_of_equal_rows_and_of_one_row(spark):
    for x in (np.ones((9, 4)), np.ones((1, 4)) * 2):
        df = frame(spark, x)
        assert sc.Reconstruction.fit(df, "x", 2).directions.shape == (4, 0)
        assert {r[0] for r in df.select(sc.Reconstruction.fit(df, "x", 2).error(sc.F.col("x"))).collect()} == {0.0}


def test_trees_do_not_depend_on_where_rows_are(spark):
    """Null keys, equal rows and one row included; a leaf's path is its depth and the mean path of its points."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)).round(1)
    rows = [(None if i < 3 else i // 2, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    grown = [{r.tree: tuple(map(tuple, r[1:])) for r in sc.grow_forest(d, "k", "x", 700, 5, 64).collect()}
             for d in (df.repartition(2), df.repartition(9))]
    assert grown[0].keys() == set(range(5)) and [t[0] for t in grown[0].values()] == [t[0] for t in grown[1].values()]
    for node, feature, cut, path in grown[0].values():
        held = set(node)
        assert all((2 * i + 1 in held and 2 * i + 2 in held) == (f >= 0) for i, f in zip(node, feature))
        assert max(node) < 2 ** 7 and all((p > 0) == (f < 0) for f, p in zip(feature, path))
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(10)], "k long, x array<double>")
    assert [list(r.feature) for r in sc.grow_forest(equal, "k", "x", 10, 2, 64).collect()] == [[-1], [-1]]


def exact_similarity(x):
    """Mean of exp(-gamma |a - b|^2) over all rows b, for every row a."""
    gamma = 1.0 / (x.shape[1] * x.var()) if x.var() else 1.0
    squares = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return np.exp(-gamma * squares).mean(axis=1)


@pytest.mark.parametrize("error", [0.1, 0.05, 0.02])
def test_kernel_keeps_its_error(spark, ws, error):
    """The root mean square error against the exact mean is below the one asked for, near and far rows included."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 6)), rng.normal(size=(20, 6)) * 4 + 3, np.zeros((5, 6))])
    rows = sc.rbf_novelty(frame(spark, x), "id", "x", ws, error=error).orderBy("id").collect()
    missed = np.array([r.score for r in rows]) - exact_similarity(x)
    assert np.sqrt((missed ** 2).mean()) < error
    assert sum(r.prediction == -1 for r in rows) == 17


def test_kernel_on_the_embeddings(spark, ws):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select(sc.F.col("vec_id").alias("id"), sc.F.col("embedding").cast("array<double>").alias("x"))
    x = np.array([r.x for r in df.orderBy("id").collect()])
    got = np.array([r.score for r in sc.rbf_novelty(df, "id", "x", ws).orderBy("id").collect()])
    assert np.abs(got - exact_similarity(x)).max() < sc.KERNEL_ERROR


def test_kernel_of_equal_rows_and_of_no_rows(spark, ws):
    assert {round(r.score, 12) for r in sc.rbf_novelty(frame(spark, np.ones((9, 4))), "id", "x", ws).collect()} == {1.0}
    assert sc.rbf_novelty(frame(spark, np.ones((1, 4))).filter("id < 0"), "id", "x", ws).collect() == []


def test_frequencies_are_counted_from_the_error():
    for d, error in [(1, 0.1), (64, 0.02), (200, 0.1)]:
        w = sc.kernel_frequencies(d, error)
        assert w.shape == (int(np.ceil(1 / (2 * error ** 2))), d)
        whole = w[:d] if len(w) >= d else w
        turned = whole @ whole.T
        assert np.allclose(turned - np.diag(np.diag(turned)), 0, atol=1e-8)
