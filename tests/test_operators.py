"""Small literal cases of the engine's operators."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.functions.stem import porter
from skein.operators import clustering, entities, graph, ingest, keywords, monitoring, quality, runs, search, tables, topics
from skein.sources import TokenBucket, backoff, file_stats, read_graph, read_jsonl, resume, snapshot, stage_status, write_csv, write_graph, write_jsonl
from skein.sources import api, stores
from skein import streaming
from skein.streaming import append_lines


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "This is [[a link]] and {{template}}", T.clean_text) == "This is a link and"
    assert one(spark, "   ", T.normalize_text) == "" and one(spark, None, T.basic_tokens) == []
    assert one(spark, "The Apple's don't x", T.keyword_tokens) == ["apple's", "don't"]
    assert one(spark, "postgres://u:secret@h/d", T.mask_password) == "postgres://u:***@h/d"
    assert one(spark, "A b/c*", T.article_url).endswith("/A_b%2Fc%2A")
    assert one(spark, "x" * 60, T.label) == "x" * 50 + "..." and one(spark, "", T.word_count) == 0


def test_ctfidf(spark):
    docs = spark.createDataFrame([(0, 0, "apple apple common"), (1, 0, "apple common"), (2, 1, "banana common"), (3, 1, "banana banana common")], "doc_idx long, cluster_id int, raw_text string")
    rows = {(r.cluster_id, r.term): r for r in keywords.ctfidf(keywords.token_counts(docs)).collect()}
    assert rows[0, "apple"].rank == 1 and rows[0, "common"].score == 0


def test_rrf_order(spark):
    frame = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "title string, rank int")
    got = search.rrf(frame("ABC"), frame("ACD")).orderBy(F.desc("score")).collect()
    assert [r.title for r in got] == list("ACBD") and math.isclose(got[0].score, 2 / 60, abs_tol=1e-8)


def nodes(spark):
    return spark.createDataFrame([(0, "A", [1.0, 0.0], 0), (1, "B", [0.0, 1.0], 0), (2, "C", [0.0, -1.0], 1), (3, "D", [-1.0, 0.0], 1)], "doc_idx long, title string, embedding array<double>, cluster_id int")


def test_graph(spark):
    links = spark.createDataFrame([("A", " b"), ("A", "C"), ("B", "C"), ("C", "D"), ("C", "missing"), ("A", "B")], "src string, dst string")
    e = graph.build(nodes(spark), links, 0.7).cache()
    assert {(r.src, r.dst, r.layer) for r in e.collect()} == {("A", "B", 1), ("A", "C", 1), ("B", "C", 1), ("C", "D", 1), ("B", "A", 2), ("D", "C", 2)}
    assert graph.find_path(e, "A", "D") == ["A", "C", "D"] and graph.find_path(e, "D", "A") is None
    assert [r.dst for r in graph.neighbors(e, "A", 1).collect()] == ["B"]
    assert graph.build(nodes(spark).limit(0), links.limit(0)).count() == 0


def test_graph_files(spark, tmp_path):
    e = graph.build(nodes(spark), None)
    write_graph(e, nodes(spark), str(tmp_path / "g"))
    n, back = read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 4 and back.count() == e.count()


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<double>").select(V.normalize(F.col("e")).alias("n")).collect()
    assert np.allclose(v[0].n, [0.6, 0.8]) and v[1].n == [0.0, 0.0]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_idx long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8}
    assert {(r.a, r.b) for r in V.similar_pairs(df, 0.8, 16).collect()} == want


def test_quality(spark):
    centers = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "cluster_id int, center array<double>")
    assert quality.diversity(centers).first() == (0.5, 1.0)
    docs = spark.createDataFrame([(0, ["x", "a"]), (0, ["x", "b"]), (1, ["y", "c"]), (1, ["y", "d"]), (2, None)], "cluster_id int, categories array<string>")
    assert math.isclose(quality.alignment(docs).first()[0], 1 / 3, abs_tol=1e-6)


def test_stability_extremes(spark):
    a = spark.createDataFrame([(str(i), i % 3) for i in range(12)], "title string, label int")
    assert tuple(monitoring.stability(a, a).first()) == (1.0, 1.0, 1.0, 12)
    assert tuple(monitoring.stability(a, a.limit(0)).first()) == (0.0, 0.0, 0.0, 0)
    assert monitoring.ks_pvalue(0.0, 50, 50) == 1.0 and monitoring.ks_pvalue(0.9, 50, 50) < 1e-6
    assert monitoring.drift_decision({"a": None, "b": 0.2}) and not monitoring.drift_decision({"a": None})


def blobs(spark, k, n=15, dims=5):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (n, dims)) for m in np.eye(k, dims) * 5])
    return spark.createDataFrame([(i, f"t{i}", r.tolist()) for i, r in enumerate(x)], "doc_idx long, title string, embedding array<double>")


def test_clustering(spark):
    df = blobs(spark, 3)
    for f in (clustering.kmeans, clustering.ward, clustering.mini_batch):
        groups = {}
        for r in f(df, 3).collect():
            groups.setdefault(r.cluster_id, set()).add(r.doc_idx // 15)
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert clustering.clamped(100, 20) == 20 and clustering.clamped(0, 20) == 1
    assert {r.cluster_id for r in clustering.kmeans(df.limit(1), 5).collect()} == {0}


def test_make_clusterer(spark):
    df = blobs(spark, 3)
    for options in ({"adaptively": True}, {"adaptively": False, "method": "AUTO"}, {"adaptively": False, "method": "kmeans", "n_clusters": 3}, {"adaptively": False, "method": "minibatch_kmeans", "n_clusters": 3}, {"adaptively": False, "method": "agglomerative", "n_clusters": 3}):
        labels, centers = clustering.make_clusterer(df, **options)
        assert labels.count() == 45 and labels.select("cluster_id").distinct().count() == 3 == centers.count()
        assert all(len(r.center) == 5 for r in centers.collect())
    labels, centers = clustering.make_clusterer(df.limit(4), False, "agglomerative", 100)
    assert labels.select("cluster_id").distinct().count() == 4
    zero = clustering.centers_of(df, clustering.kmeans(df, 2), 4).orderBy("cluster_id").collect()
    assert len(zero) == 4 and zero[3].center == [0.0] * 5


def test_search_for_k(spark):
    df = blobs(spark, 3)
    assert [clustering.search_range(n) for n in (30, 100, 300, 1000)] == [(2, 10, 100), (5, 15, 100), (10, 30, 300), (20, 50, 500)]
    for way in ("all", "halving", "coarse"):
        k, score = clustering.best_k(df, 2, 6, way=way)
        assert (k, score > 0.9) == (3, True)
    x, labels = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]]), np.array([0, 0, 1, 1, 2])
    d = np.abs(x - x.T)
    want = [(d[i, [2, 3] if i < 2 else [0, 1] if i < 4 else [2, 3]].mean(), d[i, i ^ 1] if i < 4 else 0) for i in range(5)]
    want = [min(b, d[i, 4] if i in (2, 3) else b) for i, (b, _) in enumerate(want)], [a for _, a in want]
    assert math.isclose(clustering.silhouette_of(x, labels), np.mean([(b - a) / max(a, b) if i < 4 else 0 for i, (b, a) in enumerate(zip(*want))]))
    assert clustering.silhouette_of(x, np.zeros(5)) == -1.0


def test_best_k_of_an_empty_range_and_between_grid_points(spark):
    x = np.repeat(np.eye(13), 20, 0) + np.random.default_rng(0).normal(0, 0.01, (260, 13))
    df = spark.createDataFrame([(i, f"t{i}", r.tolist()) for i, r in enumerate(x)], "doc_idx long, title string, embedding array<double>")
    low, high, _ = clustering.search_range(2550)
    assert clustering.best_k(df, low, high) == (51, -1.0)
    # the grid 10, 15, 20 ... of 500 rows
    assert clustering.best_k(df, *clustering.search_range(500)[:2])[0] == 13


def test_silhouette_of_blocks(spark):
    df = blobs(spark, 3).withColumn("cluster_id", (F.col("doc_idx") / 14).cast("int"))
    x, y = (np.array([r[c] for r in df.orderBy("doc_idx").collect()]) for c in ("embedding", "cluster_id"))
    for block in (7, 512):
        assert math.isclose(quality.silhouette(df, None, block).first()[0], clustering.silhouette_of(x, y), abs_tol=1e-6)
    assert -1 <= quality.silhouette(df, 20).first()[0] <= 1


def test_ingest_rules(spark):
    assert ingest.check_config(["a", "b", "c"], 70, 50) and not ingest.check_config(["a", "b", "c"], 10, 100)
    for bad in ((["a"], 10, 100), (["a", "b", "c"], 71, 100), (["a", "b", "c"], 10, 49)):
        with pytest.raises(ValueError):
            ingest.check_config(*bad)
    found = spark.createDataFrame([("x", 1, 0), ("x", 0, 3), ("y", 0, 1)], "title string, query int, pos int")
    assert [(r.title, r.query) for r in ingest.first_seen_budget(found, 2).collect()] == [("y", 0), ("x", 0)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"title": "T", "text": "\u00e9"}\n\nbroken\n{"title": [1}\n' + json.dumps({"title": "U"}) + "\n")
    found = read_jsonl(spark, str(tmp_path / "q.jsonl"))
    assert sorted((r.title, r.text) for r in found.collect()) == [("T", "\u00e9"), ("U", None)]
    out = str(tmp_path / "out")
    write_jsonl(spark.range(25).select(F.concat(F.lit("\u00fc"), "id").alias("title")).coalesce(1), out, per_file=10)
    assert len(list((tmp_path / "out").glob("part-*"))) == 3 and "\u00fc" in next((tmp_path / "out").glob("part-*")).read_text()
    fresh = spark.range(20, 30).select(F.concat(F.lit("\u00fc"), "id").alias("title"))
    assert resume(spark, out, fresh).count() == 5
    with pytest.raises(ValueError):
        write_csv(spark.createDataFrame([], "a string"), str(tmp_path / "c"))
    write_csv(tables.export_rows(spark.createDataFrame([('a "b"', ["x", "y"])], "t string, c array<string>")).coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*")).read_text() == '"t","c"\n"a ""b""","x; y"\n'


def test_limits():
    assert backoff(3, 1, 60, lambda: 0.5) == 8 and backoff(9, 1, 60, lambda: 0.5) == 60
    clock = iter([0, 0, 0, 0.0])
    bucket = TokenBucket(2, lambda: next(clock))
    assert bucket.wait() == 0 and bucket.wait() == 0.5
    asked, waits = [], []

    def fetch(p):
        asked.append(p)
        if len(asked) < 3:
            raise api.RateLimited("429")
        return "ok"

    assert api.patient(fetch, 1000, sleep=waits.append)({}) == "ok" and len(asked) == 3 and sum(w > 0.5 for w in waits) == 2
    with pytest.raises(api.RateLimited):
        api.patient(lambda p: (_ for _ in ()).throw(api.RateLimited("x")), 1000, 1, waits.append)({})


def test_web_sources(spark, tmp_path):
    for kind in ("search", "article"):
        (tmp_path / kind).mkdir()
    (tmp_path / "search/a%20b.json").write_text(json.dumps([{"title": f"T{i}", "snippet": "s"} for i in range(5)]))
    (tmp_path / "article/T0.json").write_text(json.dumps({"title": "T0", "text": "x", "revisions": 3, "links": [{"name": "L1"}, "L2", "L3"], "categories": ["C"]}))
    (tmp_path / "article/bad.json").write_text("{")
    spark.dataSource.register(api.SearchSource)
    out = spark.read.format("article_search").option("transport", str(tmp_path)).option("queries", '["a b", "none"]').option("limit", 3).load().collect()
    assert [(r.query, r.position, r.title, r.snippet) for r in out] == [("a b", i, f"T{i}", "s") for i in range(3)]
    titles = spark.createDataFrame([("T0",), ("T1",), ("bad",), (None,), ("T0",)], "title string")
    rows = {r.asked: r for r in api.fetch_articles(titles, str(tmp_path), links=True, categories=True, max_links=2).collect()}
    assert tuple(rows["T0"])[1:] == ("T0", "x", 3, ["C"], ["L1", "L2"], None)
    assert tuple(rows["T1"])[1:] == (None,) * 6 and rows["bad"].title is None and "Error" in rows["bad"].error
    plain = {r.asked: r for r in api.fetch_batch(titles, str(tmp_path)).collect()}
    assert len(plain) == 4 and plain["T0"].links == [] and plain["bad"].text is None and "error" not in plain["bad"].asDict()


def test_databases(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "ID int, TITLE string")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    stores.write_table(rows, url, "ARTICLES", "overwrite", **options)
    stores.write_table(rows.limit(1), url, "ARTICLES", **options)
    assert stores.read_table(spark, url, "ARTICLES", **options).count() == 21
    back = stores.read_table(spark, url, "ARTICLES", "ID", (0, 20), 3, **options)
    assert back.rdd.getNumPartitions() == 3 and back.filter("ID = 7").first().TITLE == "t7"
    assert T.jdbc_url("postgres://u:p@h:5/db") == T.jdbc_url("postgresql+asyncpg://h:5/db") == "jdbc:postgresql://h:5/db"


def test_models_reports_and_configuration(spark, tmp_path):
    df = blobs(spark, 3)
    labels, centers = clustering.make_clusterer(df, False, "kmeans", 3)
    f = clustering.features(df)
    stores.write_model(str(tmp_path / "m"), labels, centers, clustering.fit_best(f, 3, 1, 10, 1), method="kmeans")
    l, c, m, about = stores.read_model(spark, str(tmp_path / "m"))
    assert l.count() == 45 and c.count() == 3 and len(m.clusterCenters()) == 3 and about == {"method": "kmeans"}
    path = str(tmp_path / "report")
    assert stores.read_report(spark, path) is None
    stores.write_report(spark, {"a": np.float32(0.5), "b": float("nan"), 3: np.arange(2), "d": {"x": True}}, path)
    assert stores.read_report(spark, path) == {"a": 0.5, "b": None, "3": [0, 1], "d": {"x": True}}
    one = spark.sql("SELECT CAST('nan' AS DOUBLE) AS a, CAST(1.5 AS DECIMAL(5, 2)) AS b, timestamp_ntz'2024-01-02 03:04:05' AS c, array(1) AS d")
    assert stores.metrics_text(one).first()[0] == '{"b":1.5,"c":"2024-01-02T03:04:05","d":[1]}'
    (tmp_path / "c.json").write_text(json.dumps({"queries": ["a"], "rate": 5, "other": 1}))
    config = stores.Config.from_file(str(tmp_path / "c.json"))
    config.per_query = 9
    config.to_file(str(tmp_path / "c.json"))
    assert stores.Config.from_file(str(tmp_path / "c.json")) == config and config.extra == {"other": 1}


def test_artifacts(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(a)
    snapshot(spark, {"summaries": a}, b)
    assert spark.read.parquet(f"{b}/summaries").count() == 3 and file_stats(spark, a).filter("length > 0").count() > 0
    s = {r.stage: r for r in stage_status(spark, {"one": [a], "two": [a, str(tmp_path / "none")]}).collect()}
    assert s["one"].has_artifacts and s["one"].size > 0 and s["one"].last_modified and not s["two"].has_artifacts and s["two"].last_modified is None


def test_records_and_texts(spark):
    raw = spark.createDataFrame([("", "N", None, None), ("T", None, "x", "c")], "title string, name string, text string, categories string")
    assert [tuple(r) for r in ingest.normalize_record(raw).collect()] == [("N", "", [], []), ("T", "x", ["c"], [])]
    assert ingest.normalize_record(spark.createDataFrame([(1,)], "id int")).first() == (1, None, "", [], [])
    with pytest.raises(ValueError):
        ingest.positional(spark.range(2).withColumnRenamed("id", "doc_idx"), spark.range(3).withColumnRenamed("id", "doc_idx"))
    with pytest.raises(ValueError):
        ingest.check_columns(raw, "embedding")
    assert [porter(w) for w in "caresses ponies relational hopping vietnamization controll sky".split()] == "caress poni relat hop vietnam control sky".split()
    assert one(spark, "The Motoring ponies", lambda c: T.normalize_text(c, stem=True)) == "motor poni"
    assert one(spark, None, T.normalize_text) == "" and T.prepared_tokens() is T.basic_tokens
    assert [one(spark, x, T.cluster_color) for x in ()] == [] and one(spark, "x/y-z", T.metric_name) == "x_y_z"


def test_topic_lookup(spark):
    corpus = spark.createDataFrame([(0, "A", 0, [0.0, 1.0]), (1, "B", 0, [0.0, 2.0]), (2, "C", 1, [5.0, 0.0]), (3, "a", 1, [5.0, 0.1])], "doc_idx long, title string, cluster_id int, embedding array<double>")
    s = spark.createDataFrame([(0, 2, ["k"], ["A", "B"])], "cluster_id int, size long, keywords array<string>, top_articles array<string>")
    t = topics.lookup(corpus, s, " b ", 2)
    assert (t.title, t.cluster_id, t.similar, t.keywords, t.explanation) == ("B", 0, ["A"], ["k"], {"cluster_size": 2, "top_articles": ["A", "B"]})
    assert topics.lookup(corpus, s, "A").title == "a" and topics.lookup(corpus, s, "C").keywords is None  # the last of a title counts
    for bad in (lambda: topics.lookup(corpus, s, "nowhere"), lambda: topics.summary(s, 7)):
        with pytest.raises(KeyError):
            bad()
    assert topics.summary(s, 0)["top_articles"] == ["A", "B"] and topics.overview(s).columns == ["cluster_id", "size", "keywords"]
    t = spark.createDataFrame([(1, 5, None, None), (2, 9, ["Apple"], ["zed"])], s.schema)
    assert [r.name for r in topics.cluster_table(t, sort="name", descending=False).orderBy("position").collect()] == ["Cluster 1", "zed"]
    assert [r.cluster_id for r in topics.cluster_table(t, "APPLE").collect()] == [2]


def test_search_requests(spark):
    assert [search.clamp(k) for k in (0, 7, 99)] == [1, 7, 50]
    docs = spark.createDataFrame([(0, "A", "x y"), (1, "B", "y")], "doc_idx long, title string, raw_text string")
    v = spark.createDataFrame([(0, "A", 0, [1.0, 0.0]), (1, "B", 1, [0.0, 1.0])], "doc_idx long, title string, cluster_id int, embedding array<double>")
    assert search.keyword_search(docs, "  ", 5).count() == 0 and search.request(docs, " ", 5, lambda q, k: docs.limit(k)).count() == 0
    with pytest.raises(ValueError):
        search.build_index(docs.limit(0), ["raw_text"])
    assert [r.title for r in search.hybrid(docs, v, "y", [1.0, 0.0], 5, 1.0, 0.0, 1).collect()] == ["B"]
    both = search.hybrid(docs, v, "y", [1.0, 0.0], 5, 2.0, 2.0, 0).orderBy("rank").collect()
    assert [(r.title, r.rank) for r in both] == [("A", 1), ("B", 2)] and math.isclose(both[0].score, 0.5 / 61 + 0.5 / 62, abs_tol=1e-8)
    assert search.hybrid(docs, v, "y", [1.0, 0.0], 5, 0.0, 0.0).count() == 0


def test_entities(spark):
    cache = spark.createDataFrame([("a", "Q1"), ("b", None)], "title string, qid string")
    titles = spark.createDataFrame([("A",), ("B",), ("C",), ("c",), ("D",), (None,)], "title string")
    asked = entities.search_entities(lambda p: {"search": [{"id": "Q" + p["search"].lower()}]} if p["search"].lower() == "c" else {})
    out, new = entities.linked_batch(titles, cache, asked)
    assert sorted((r.title or "", r.qid, r.state) for r in out.collect()) == [("", None, "miss"), ("A", "Q1", "found"), ("B", None, "absent"), ("C", "Qc", "found"), ("D", None, "absent"), ("c", "Qc", "found")]
    assert sorted(map(tuple, new.collect())) == [("a", "Q1"), ("b", None), ("c", "Qc"), ("d", None)]
    assert entities.search_entities(lambda p: 1 / 0)("x") is None and entities.named("math:sqrt")(4.0) == 2


def test_runs(spark):
    r = spark.createDataFrame([("a", "e", 1, "FAILED", "Alembic x"), ("b", "e", 5, "FAILED", "other"), ("c", "e", 9, "FINISHED", "migration"), ("d", "f", 2, None, None)], "run_id string, experiment_id string, t int, status string, info string")
    r = r.withColumn("start_time", F.timestamp_seconds(F.col("t") * 86400)).drop("t")
    now = F.timestamp_seconds(F.lit(86400 * 10))
    ids = lambda df: sorted(x.run_id for x in df.collect())
    assert ids(runs.to_clean(r, now, 6)) == ["a", "d"] and ids(runs.to_clean(r, now, 6, 1)) == ["a", "b"] and ids(runs.to_clean(r)) == []
    assert ids(runs.corrupted(r)) == ["a", "d"]
    gone = runs.to_clean(r, now, 6)
    assert runs.cleanup(r, gone)[1] == {"found": 4, "deleted": 0, "would_delete": 2, "kept": 2}
    left, told = runs.cleanup(r, gone, False)
    assert ids(left) == ["b", "c"] and told == {"found": 4, "deleted": 2, "kept": 2}
    e = spark.createDataFrame([("e", {"x": "1"}), ("f", None)], "name string, tags map<string,string>")
    assert {x.name: x.tags for x in runs.tag(e, "e", {"x": 2, "y": "z"}).collect()} == {"e": {"x": "2", "y": "z"}, "f": None}
    m = runs.log_metrics(spark.createDataFrame([], "run_id string, metric string, value double"), "a", monitoring.metric_rows(spark.sql("SELECT 1 AS `p/q`, true AS t, 'x' AS s")), "drift")
    assert [tuple(x) for x in m.collect()] == [("a", "drift_p_q", 1.0)]
    s = runs.start(spark.createDataFrame([("a", now_value, "failed", "x")] if (now_value := None) else [], "run_id string, started_at timestamp, status string, current_stage string"), "a", now)
    s = runs.update(runs.start(s, "a", now), "a", "done", "graph")
    assert [(x.run_id, x.status, x.current_stage) for x in s.collect()] == [("a", "done", "graph")]
    assert runs.delete_run(r, r)[0].count() == 0


def test_drift(spark):
    rng = np.random.default_rng(1)
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_idx long, embedding array<double>")
    base, same, other = rng.normal(size=(200, 4)) * [5, 1, 1, 1], rng.normal(size=(150, 4)) * [5, 1, 1, 1], rng.normal(size=(150, 4)) * [5, 1, 1, 1] + [9, 0, 0, 0]
    far = monitoring.embedding_drift(frame(base), frame(other))
    assert far["drift_detected"] and far["ks_pvalue"] < 1e-6 and far["ks_statistic"] > 0.5 and abs(far["mean_drift"] - 9) < 1.5
    assert not monitoring.embedding_drift(frame(base), frame(same))["drift_detected"] and monitoring.embedding_drift(frame(base), frame(base), 50)["ks_pvalue"] == 1.0
    assert monitoring.embedding_drift(frame(base).limit(0), frame(base).limit(0))["ks_pvalue"] == 1.0
    t = spark.createDataFrame([("a b",), ("a",), (None,)], "cleaned_text string")
    assert monitoring.text_drift(t, t)["vocab_jaccard"] == 1.0 and monitoring.text_drift(t.limit(0), t) == {} and monitoring.text_drift(t, t.drop("cleaned_text")) == {}
    c = spark.createDataFrame([("x", 0), ("y", 1)], "title string, cluster_id int")
    assert monitoring.cluster_drift(c, c.limit(0)) == {"cluster_drift": 1.0, "assignment_overlap": 0.0} and monitoring.cluster_drift(c, c)["cluster_size_ks_pvalue"] == 1.0
    assert monitoring.drift_metrics({}, {}) == {"drift_detected": False, "reason": "no_baseline"}
    out = monitoring.drift_metrics({"embeddings": frame(base), "articles": t, "assignments": c}, {"embeddings": frame(other), "articles": t, "assignments": c})
    assert out["drift_detected"] and out["threshold"] == 0.3 and {"embedding_ks_pvalue", "text_length_ks_pvalue", "cluster_cluster_size_ks_pvalue"} <= set(out)
    assert monitoring.numeric({"a": 1, "b": True, "c": "x"}) == {"a": 1.0} and monitoring.numeric({"b": True}, True) == {"b": 1.0}


def test_ks_pvalue_counts_paths():
    import itertools

    for n, m in ((4, 5), (5, 5), (3, 7), (6, 4)):
        greatest = []
        for up in itertools.combinations(range(n + m), n):
            i = np.cumsum(np.isin(np.arange(n + m), up))
            greatest.append(np.abs(i / n - (np.arange(1, n + m + 1) - i) / m).max())
        for d in sorted({round(g, 9) for g in greatest}):
            assert math.isclose(monitoring.ks_pvalue(d, n, m), np.mean(np.array(greatest) >= d - 1e-6), abs_tol=1e-9)
    assert math.isclose(monitoring.ks_pvalue(0.05, 4000, 4000), monitoring.ks_pvalue(0.05, 4000, 4000, 0), rel_tol=0.1)


def test_running_sums(spark):
    df = spark.createDataFrame([(k % 3, k, 1 + k % 5) for k in range(500)], "g int, x int, n int")
    got = {(r.g, r.x): r.n_to for r in monitoring.running(df, "x", ["n"], ["g"]).collect()}
    for g in range(3):
        total = 0
        for k in range(g, 500, 3):
            total += 1 + k % 5
            assert got[g, k] == total


def test_graph_around_a_title(spark):
    links = spark.createDataFrame([("A", " b"), ("A", "C"), ("B", "C"), ("C", "a"), ("A", "A")], "src string, dst string")
    n = nodes(spark).withColumn("embedding", F.when(F.col("title") == "D", F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.col("embedding")))
    whole = {tuple(r) for r in graph.build(n, links, 0.7).collect()}
    assert {tuple(r) for r in graph.around(n, links, "A", 0.7).collect()} == {r for r in whole if r[0] == "A"}
    assert {tuple(r) for r in graph.around(n, links, "A", 0.7, incoming=True).collect()} == {r for r in whole if "A" in r[:2]}
    assert graph.around(n, links, "nowhere").count() == 0
    some, e = graph.visualization(n, graph.build(n, links, 0.7), ["C", "x", "A", "B"], 3)
    assert [r.title for r in some.orderBy("position").collect()] == ["C", "A"] and {(r.src, r.dst) for r in e.collect()} == {("A", "C"), ("C", "A"), ("A", "A")}
    shown = graph.visible(spark.createDataFrame([("a", "b", x, 1.0, "t") for x in (0, 1, 2, 3, None)], "src string, dst string, layer int, weight double, type string"), cluster=False)
    assert sorted(r.layer for r in shown.collect()) == [1, 3]


def test_embedders(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "B a", None, "c"])], "doc_idx long, raw_text string")
    rows = {r.doc_idx: np.array(r.embedding) for r in V.hash_embeddings(docs, dim=32).collect()}
    assert np.allclose(rows[0], rows[1]) and not rows[2].any() and math.isclose(np.linalg.norm(rows[3]), 1.0)

    class Lengths:
        dim = 1

        def encode(self, texts):
            return np.array([[len(t)] for t in texts], float)

    assert [r.embedding for r in V.embed(docs, Lengths, batch=3).orderBy("doc_idx").collect()] == [[3.0], [3.0], [0.0], [1.0]]


def test_progress_and_upsert(spark):
    s = spark.createDataFrame([("ingestion", "completed", 0), ("preprocessing", "running", 50), ("clustering", "running", 0), ("graph", "pending", 0)], "stage string, status string, progress int")
    assert tables.overall_progress(s).first()[0] == 37.5
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, tables.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("DEBUG: x\nINFO: y\n")
    append_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["INFO: y"]


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema, states = "run_id string, state string, timestamp long", "AABBA"
    for k, part in enumerate((states[:2], states[2:])):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"run_id": "r", "state": x, "timestamp": 10 * k + i}) for i, x in enumerate(part)))
        os.utime(tmp_path / f"in/{k}.json", (1000 + k, 1000 + k))
    want = [("A", 0), ("B", 10), ("A", 12)]
    batch = streaming.progress_changes(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert [(r.state, r.timestamp) for r in batch.orderBy("timestamp").collect()] == want
    stream = streaming.progress_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in")))
    out = streaming.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.timestamp, r.state) for r in out.collect())[0] == (0, "A") and out.count() == 3
    s = spark.createDataFrame([("r", "a", "completed"), ("r", "b", "error"), ("q", "a", "running")], "run_id string, stage string, status string")
    assert [r.run_id for r in streaming.done(s).collect()] == ["r"]


def test_incremental_ingest_and_retention(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id long, timestamp long"
    put = lambda k: (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + i, "timestamp": 10 * k + i}) for i in range(10)) + "\nbroken\n")
    go = lambda: streaming.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    for k in range(3):
        put(k)
        go()
    go()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).filter("id is not null").collect()) == list(range(30))
    stream = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).filter("id is not null")
    streaming.retain(stream, str(tmp_path / "kept"), str(tmp_path / "cp2"), 5).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept/2")).collect()) == list(range(25, 30))


def test_sliding_stream_equals_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "e", float(h + m), 200 + 300 * (m == 20)) for h in range(4) for m in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "t string, endpoint string, latency_ms double, status_code int").select(F.to_timestamp("t").alias("timestamp"), "endpoint", "latency_ms", "status_code")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streaming.run_to_table(streaming.request_windows(stream, "1 hour", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    whole = {tuple(r) for r in streaming.request_windows(df, "1 hour", "30 minutes").collect()}
    got = {tuple(r) for r in out.collect()}
    closed = df.agg(F.max("timestamp")).first()[0]
    assert got == {r for r in whole if (closed - r[0]).total_seconds() >= 4200}
