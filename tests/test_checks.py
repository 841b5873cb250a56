"""Drift and stability runs: without a baseline, with one broken table, and over whole folders; graph views."""

import random

import pytest

from skein.operators import checks, graph, monitoring
from skein.sources.stores import read_report


def frames(spark, shift=0):
    rng = random.Random(3 + shift)
    vectors = [(i, [rng.gauss(shift, 1) for _ in range(4)]) for i in range(60)]
    texts = [(i, " ".join(f"w{rng.randrange(30 + 10 * shift)}" for _ in range(5 + 5 * shift))) for i in range(60)]
    labels = [(f"T{i}", i % (3 + shift)) for i in range(60)]
    return {
        "embeddings": spark.createDataFrame(vectors, "doc_idx long, embedding array<double>"),
        "articles": spark.createDataFrame(texts, "doc_idx long, cleaned_text string"),
        "assignments": spark.createDataFrame(labels, "title string, cluster_id int"),
        "summaries": spark.createDataFrame([(c, 20 + c) for c in range(3 + shift)], "cluster_id int, size long"),
    }


def written(tables, folder):
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    return str(folder)


def rows(spark, path):
    return {r.metric: r.value for r in spark.read.parquet(str(path)).collect()}


def test_drift_run_without_and_with_a_baseline(spark, tmp_path):
    now, base = written(frames(spark), tmp_path / "now"), str(tmp_path / "base")
    found = checks.run_drift(spark, base, now, "r1", str(tmp_path / "m1"), str(tmp_path / "report"))
    assert found == {"drift_detected": False, "reason": "no_baseline"} == read_report(spark, str(tmp_path / "report"))
    assert rows(spark, tmp_path / "m1") == {"drift_drift_detected": 0.0}
    # the first run left its tables as the baseline
    written(frames(spark, 2), tmp_path / "now")
    found = checks.run_drift(spark, base, now, "r2", str(tmp_path / "m2"), str(tmp_path / "report"), save_baseline=False)
    same = monitoring.drift_metrics(*({n: spark.read.parquet(f"{x}/{n}") for n in checks.TABLES[:3]} for x in (base, now)))
    assert found == same and found["drift_detected"] is True
    logged = rows(spark, tmp_path / "m2")
    assert logged["drift_drift_detected"] == 1.0 and logged["drift_threshold"] == 0.3 and logged["drift_embedding_mean_drift"] == found["embedding_mean_drift"]
    assert read_report(spark, str(tmp_path / "report"))["text_vocab_drift"] == found["text_vocab_drift"]


def test_one_broken_table_leaves_the_others_figures(spark, tmp_path):
    base, now = written(frames(spark), tmp_path / "base"), written(frames(spark, 1), tmp_path / "now")
    spark.range(3).write.mode("overwrite").parquet(f"{now}/assignments")  # other columns
    found = checks.run_drift(spark, base, now, "r", save_baseline=False)
    assert "embedding_ks_pvalue" in found and "text_vocab_drift" in found and not any(k.startswith("cluster_") for k in found)
    (tmp_path / "now/articles/part-broken.parquet").write_text("no parquet")
    assert "embedding_ks_pvalue" in checks.run_drift(spark, base, now, "r", save_baseline=False)


def test_stability_runs(spark, tmp_path):
    base, now = str(tmp_path / "base"), written(frames(spark, 1), tmp_path / "now")
    assert checks.run_stability(spark, base, now, "r", str(tmp_path / "m")) == {"stability_calculated": False, "reason": "no_baseline"}
    assert not checks.exists(spark, str(tmp_path / "m"))
    written(frames(spark), base)
    found = checks.run_stability(spark, base, now, "r", str(tmp_path / "m"))
    assert found["stability_calculated"] is True and found["evolution_birth_count"] == 1 and found["evolution_birth_clusters"] == [3] and found["overlap"] == 60
    logged = rows(spark, tmp_path / "m")
    assert logged["stability_ari"] == found["ari"] and logged["stability_evolution_birth_count"] == 1.0 and "stability_stability_calculated" not in logged
    spark.range(3).write.mode("overwrite").parquet(f"{now}/assignments")
    broken = checks.run_stability(spark, base, now, "r")
    assert broken["stability_calculated"] is False and "error" in broken


@pytest.fixture(scope="module")
def small_graph(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, f"N{i}", [rng.gauss(0, 1) for _ in range(3)], i % 4) for i in range(60)], "doc_idx long, title string, embedding array<double>, cluster_id int")
    links = spark.createDataFrame([(f"N{rng.randrange(60)}", f" n{rng.randrange(80)} ") for _ in range(150)], "src string, dst string")
    return nodes, links, graph.build(nodes, links, 0.8).cache()


def told(df):
    return sorted(map(tuple, df.select("src", "dst", "layer", "weight", "type").collect()))


def test_views_equal_those_of_the_whole_graph(spark, small_graph):
    nodes, links, edges = small_graph
    some = nodes.filter("doc_idx % 3 = 0")
    assert told(graph.induced_graph(nodes, links, some, 0.8)) == told(graph.induced(edges, some))
    assert told(graph.ego_view(nodes, links, "N7", 0.8, 6)) == told(graph.ego(edges, "N7", 6))
    named, found = graph.cluster_view(nodes, links, 2, 0.8)
    inner = nodes.filter("cluster_id = 2")
    assert {r.title for r in named.filter("inside").collect()} == {r.title for r in inner.collect()}
    near = {r.dst for r in edges.filter("layer = 3").join(inner.withColumnRenamed("title", "src"), "src", "left_semi").collect()}
    assert {r.title for r in named.collect()} == near | {r.title for r in inner.collect()}
    ends = {r.title for r in named.collect()}
    own = {r.title for r in inner.collect()}
    assert told(found) == [e for e in told(edges) if e[0] in own and e[1] in ends]


def test_views_keep_their_limits(spark, small_graph):
    nodes, links, _ = small_graph
    named, found = graph.cluster_view(nodes, links, 1, 0.8, 5, 3)
    kept = {r.title: r.inside for r in named.collect()}
    assert sum(kept.values()) == 5 and len(kept) == 8 and {r.src for r in found.collect()} <= {t for t, x in kept.items() if x}
    assert kept == {r.title: r.inside for r in graph.cluster_view(nodes, links, 1, 0.8, 5, 3)[0].collect()}
    assert graph.cluster_view(nodes, links, 99, 0.8)[0].collect() == []
