"""The 2-D map: weights, curve, and neighbourhoods kept better than by principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import cells, clustering, layout

N = 500


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    label = rng.integers(0, 12, N)
    x = rng.normal(size=(12, 24))[label] + 0.3 * rng.normal(size=(N, 24))
    return label, x, spark.createDataFrame([(i, f"T{i}", [float(a) for a in r]) for i, r in enumerate(x)], "doc_idx long, title string, embedding array<double>").repartition(4)


def places(df):
    return np.array([(r.x, r.y) for r in df.orderBy("doc_idx").collect()])


def trustworthiness(x, y, k=10):
    """1 less the ranks beyond k of the map's false neighbours, scaled (Venna and Kaski)."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, m = -(u @ u.T), ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, -np.inf), np.fill_diagonal(m, -np.inf)
    rank, near, n = d.argsort(1).argsort(1), m.argsort(1)[:, 1 : k + 1], len(x)
    return 1 - 2 * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum() / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("block", [2048, 128])
def test_map_keeps_neighbourhoods_and_reruns_agree(spark, clustered, block):
    label, x, df = clustered
    pca = places(clustering.project(df).select("doc_idx", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y")))
    y = places(layout.map_2d(df, rounds=4, steps=25, block=block))
    assert trustworthiness(x, y) > max(0.93, trustworthiness(x, pca) + 0.03)
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (label[d.argmin(1)] == label).mean() > 0.95
    if block == 128:
        assert (places(layout.map_2d(df, rounds=4, steps=25, block=block)) == y).all()


def test_weights_add_up_and_merge_both_directions(spark, clustered):
    d = np.sort(np.random.default_rng(2).random((30, 15)), 1)
    w = layout.fuzzy_weights(d)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-6) and (w[:, 0] == 1).all()
    assert np.isfinite(layout.fuzzy_weights(np.zeros((2, 5)))).all()
    edges = {(r.src, r.dst): r.w for r in layout.weighted_edges(cells.neighbor_graph(clustered[2], 5)).collect()}
    assert len(edges) == 5 * N and all(0 < w <= 1 for w in edges.values())
    assert all(abs(w - edges[b, a]) < 1e-12 for (a, b), w in edges.items() if (b, a) in edges)


def test_curve_and_few_rows(spark):
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)]
    df = spark.createDataFrame(rows, "doc_idx long, embedding array<double>")
    assert sorted(r.doc_idx for r in layout.map_2d(df, rounds=1, steps=2).collect()) == [1, 2]
    assert [tuple(r) for r in layout.map_2d(df.filter("doc_idx = 1")).collect()] == [(1, 0.0, 0.0)]
    assert layout.map_2d(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(40)], "doc_idx long, embedding array<double>")
    assert np.isfinite(places(layout.map_2d(same, rounds=2, steps=5))).all()
