"""Models that SQL can't repeat: the hashed embedder by its definition, k-means by its cost, drift by plain figures."""

import math
import zlib

import numpy as np

from skein.functions import vectors as V
from skein.operators import clustering, monitoring
from skein.plans import catalog
from skein.session import articles

SF = "/root/testdata/sf0.001"


def test_hash_embeddings_equal_their_definition(spark):
    docs = [(1, "The river and the River"), (2, ""), (3, None), (4, "a b\tc\nd " * 50)]
    got = {r.doc_idx: r.embedding for r in V.hash_embeddings(spark.createDataFrame(docs, "doc_idx long, raw_text string"), dim=32).collect()}
    for i, text in docs:
        want = [0.0] * 32
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            want[h % 32] += 1.0 if h >= 1 << 31 else -1.0
        size = math.sqrt(sum(x * x for x in want))
        assert np.allclose(got[i], [x / size if size else x for x in want])
    whole = catalog.QUERIES["hash_embeddings"](spark, SF)
    assert whole.count() == articles(spark, SF).count() and whole.selectExpr("max(size(embedding)) m").first().m == 384


def lloyd(x, k, seed, rounds=50):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return ((x - c[label]) ** 2).sum()


def test_kmeans_costs_no_more_than_a_plain_run(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] * 3 + rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, f"T{i}", [float(a) for a in r]) for i, r in enumerate(x)], "doc_idx long, title string, embedding array<double>")
    label = np.array([r.cluster_id for r in clustering.kmeans(df, 6, starts=4).orderBy("doc_idx").collect()])
    cost = sum(((x[label == j] - x[label == j].mean(0)) ** 2).sum() for j in set(label.tolist()))
    assert len(set(label.tolist())) == 6 and cost <= 1.05 * min(lloyd(x, 6, s) for s in range(10))


def test_embedding_drift_by_plain_figures(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(80, 5)) * [3, 1, 1, 1, 1], rng.normal(size=(70, 5)) + 0.4
    frame = lambda x: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_idx long, embedding array<double>")
    got = monitoring.embedding_drift(frame(a), frame(b))
    axis = np.linalg.svd(a - a.mean(0))[2][0]
    p, q = np.sort(a @ axis), np.sort(b @ axis)
    both = np.concatenate([p, q])
    ks = np.abs(np.searchsorted(p, both, "right") / 80 - np.searchsorted(q, both, "right") / 70).max()
    assert abs(got["ks_statistic"] - ks) < 1e-9
    assert abs(got["mean_drift"] - np.linalg.norm(a.mean(0) - b.mean(0))) < 1e-5 and abs(got["std_drift"] - np.linalg.norm(a.std(0) - b.std(0))) < 1e-5
