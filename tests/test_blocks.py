"""Blocks: the graph's layers, counts and views, silhouette and nearest neighbours against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, cells, clustering, graph, quality

N = 260


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 6))
    x[30:60] = x[30]
    x[7] = 0
    cluster = [None if i % 41 == 0 else i % 4 for i in range(N)]
    rows = [(3 * i - 50, f"T{i}", None if i % 50 == 49 else [float(a) for a in r], cluster[i]) for i, r in enumerate(x)]
    nodes = spark.createDataFrame(rows, "doc_idx long, title string, embedding array<double>, cluster_id int").repartition(3)
    pairs = [(f"T{i}", f" t{(7 * i + 3) % N}") for i in range(N)] + [(f"T{i}", f"T{i + 1}") for i in range(N)] * 2 + [("stranger", "t5"), ("T5", "nowhere"), ("T9", "T9")]
    return x, cluster, nodes, spark.createDataFrame(pairs, "src string, dst string"), pairs


def brute(made, threshold):
    x, cluster, _, _, pairs = made
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    u[[i for i in range(N) if i % 50 == 49]] = np.nan
    sim, out = u @ u.T, {}
    for i in range(N):
        for j in range(N):
            if i != j and cluster[i] is not None and cluster[i] == cluster[j]:
                out[f"T{i}", f"T{j}"] = 2
    names = {f"t{i}": f"T{i}" for i in range(N)}
    out |= {(a, names[b.strip().lower()]): 1 for a, b in pairs if b.strip().lower() in names}
    return out | {(f"T{i}", f"T{j}"): 3 for i, j in zip(*np.nonzero(sim >= threshold)) if i != j}


@pytest.fixture(params=[40, 2048])
def block(request, monkeypatch):
    packed = blocks.packed
    monkeypatch.setattr(blocks, "packed", lambda *a, **o: packed(*a, **{"block": request.param} | o))
    monkeypatch.setattr(blocks, "AT_ONCE", 16)


def test_layers_equal_brute_force(made, block):
    _, _, nodes, links, _ = made
    want = brute(made, 0.6)
    got = graph.build(nodes, links, 0.6).collect()
    assert {(r.src, r.dst): r.layer for r in got} == want and len(got) == len(want)
    assert {r.type for r in got if r.layer != 3} == {"link", "cluster"} and all(r.weight == 1 for r in got if r.layer != 3) and all(r.weight >= 0.6 for r in got)
    n = {k: sum(v == k for v in want.values()) for k in (1, 2, 3)}
    assert {r.layer: r.n for r in graph.layer_counts(nodes, links, 0.6).collect()} == n and all(n.values())
    assert {(r.src, r.dst) for r in graph.semantic_edges(nodes, 0.6).collect()} == {k for k, v in want.items() if v == 3}


def test_repeated_titles_are_one_node(spark):
    nodes = spark.createDataFrame([(0, "A", [1.0, 0.0], 0), (1, "B", [0.0, 1.0], 0), (2, "B", [1.0, 0.1], 0)], "doc_idx long, title string, embedding array<double>, cluster_id int")
    got = graph.build(nodes, None, 0.9)
    assert sorted((r.src, r.dst, r.layer) for r in got.collect()) == [("A", "B", 3), ("B", "A", 3), ("B", "B", 2)]
    assert {r.layer: r.n for r in graph.layer_counts(nodes, None, 0.9).collect()} == {3: 2, 2: 1}


def test_edges_that_leave_some_titles(made, block):
    _, _, nodes, links, _ = made
    some = nodes.filter("title in ('T3', 'T31', 'T7', 'T49')")
    want = {k: v for k, v in brute(made, 0.6).items() if k[0] in ("T3", "T31", "T7", "T49")}
    assert {(r.src, r.dst): r.layer for r in graph.leaving(nodes, links, some, 0.6).collect()} == want


def test_a_large_cluster_is_whole(made, block):
    """Over 100 nodes, with no limit on them: all are inside, and neighbours of any of them are outside."""
    _, _, nodes, links, _ = made
    nodes = nodes.withColumn("cluster_id", F.when(F.col("doc_idx") < 350, 3).otherwise(1))
    inside = {r.title for r in nodes.filter("cluster_id = 3").collect()}
    near = {k[1] for k, v in brute(made, 0.6).items() if v == 3 and k[0] in inside} - inside
    for external, n in ((None, len(near)), (50, min(50, len(near)))):
        got = graph.cluster_reach(nodes, 3, 0.6, max_nodes=None, external=external).collect()
        assert {r.title for r in got if r.inside} == inside and len(inside) > 100
        assert len(got) == len(inside) + n and {r.title for r in got if not r.inside} <= near
    edges = graph.build(nodes, links, 0.6)
    assert {tuple(r) for r in graph.cluster_nodes(nodes, edges, 3, None, None).collect()} == {tuple(r) for r in graph.cluster_reach(nodes, 3, 0.6, None, None).collect()}
    assert graph.cluster_nodes(nodes, edges, 3).filter("inside").count() == 100


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_silhouette_of_odd_rows(made, block):
    """Copies, a zero vector and rows without a cluster; what is shuffled is one row of sums a block and part."""
    x, cluster, nodes, _, _ = made
    keep = [i for i in range(N) if i % 50 != 49]
    some = [i for i in keep if cluster[i] is not None]
    d = np.sqrt(((x[keep][:, None] - x[some][None]) ** 2).sum(2))
    label, score = np.array([cluster[i] for i in some]), []
    for at, i in enumerate(keep):
        mean = {c: d[at][label == c].sum() / ((label == c).sum() - (c == cluster[i])) for c in range(4)}
        a, b = mean.pop(cluster[i], 0), min(mean.values())
        score.append(0 if cluster[i] is None else (b - a) / max(a, b))
    got = quality.silhouette(nodes, None)
    assert abs(got.first()[0] - np.mean(score)) < 1.5e-6 and shuffles(got) == 1
    assert quality.silhouette(nodes.filter("cluster_id = 1"), None).first()[0] is None


def test_neighbors_of_many_blocks(made, monkeypatch):
    """Between blocks too they equal brute force, and what a task hands on is shuffled alone."""
    x, _, nodes, _, _ = made
    monkeypatch.setattr(cells, "LEAST", 16)
    keep = np.array([i for i in range(N) if i % 50 != 49])
    u = x[keep] / np.where((n := np.linalg.norm(x[keep], axis=1, keepdims=True)) == 0, 1, n)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    ids = 3 * keep - 50
    want = {(int(ids[i]), int(ids[j]), k) for i in range(len(keep)) for k, j in enumerate(np.lexsort((ids, d[i]))[:5], 1)}
    got = cells.neighbor_graph(nodes, 5, 16)
    assert shuffles(got) == 1
    assert {(r.doc_idx, r.other, r["rank"]) for r in got.collect()} == want


def test_many_starts_go_in_the_same_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 8)), 20, 0) + 0.05 * rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, f"T{i}", [float(a) for a in r]) for i, r in enumerate(x)], "doc_idx long, title string, embedding array<double>").repartition(3)

    def cost(labels):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        of = np.array([r.cluster_id for r in labels.orderBy("doc_idx").collect()])
        return sum(((u[of == c] - u[of == c].mean(0)) ** 2).sum() for c in range(30))

    one = cost(clustering.kmeans(df, 30))
    monkeypatch.setattr(clustering, "KMeans", None)  # no start has a fit of its own
    many = clustering.kmeans(df, 30, starts=10)
    assert many.columns == ["doc_idx", "title", "cluster_id"] and many.count() == 600
    assert cost(many) <= one * 1.0001
    assert clustering.kmeans(df.filter("doc_idx < 3"), 30, starts=10).select("cluster_id").distinct().count() == 3


@pytest.mark.parametrize("block, copies", [(16, 64), (16, 3), (1024, 64)])
def test_cluster_edges_of_blocks(made, spark, block, copies):
    _, cluster, nodes, _, _ = made
    odd = spark.createDataFrame([(None, "no number", None, 1), (-50, "again", None, 1), (5000, None, None, 2)], nodes.schema)
    got = sorted((str(r.src), str(r.dst)) for r in graph.cluster_edges(nodes.unionByName(odd), block, copies).collect())
    rows = [(3 * i - 50, f"T{i}", c) for i, c in enumerate(cluster)] + [(-50, "again", 1), (5000, "None", 2)]
    assert got == sorted((s, t) for i, s, c in rows for j, t, d in rows if c is not None and c == d and i != j)


def test_a_large_clusters_edges_are_made_by_many_tasks(spark):
    nodes = spark.range(600).select(F.col("id").alias("doc_idx"), F.concat(F.lit("T"), "id").alias("title"), F.lit(1).alias("cluster_id"))
    made = graph.cluster_edges(nodes).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(made) == 600 * 599
    made = graph.cluster_edges(nodes, 60).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(made) == 600 * 599 and max(made) < 0.7 * sum(made)
    assert graph.cluster_edges(nodes.limit(0)).count() == 0
