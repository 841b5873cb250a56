"""Queries on structures that the library stores or derives: cells, neighbour graphs, maps, positional indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lemma
from ..functions import vectors as V
from ..operators import cells, checks, clustering, fulltext, graph, keywords, layout, search
from ..session import articles, links, vectors, work_dir
from .catalog import _A, _COS, _COUNTS, _E1, _EUCLID, _G, _HYBRID, _L, _V, SQL, _halves, _sides, query, vector_of
from .extended import _summary_halves


@query(f"WITH {_V}, q AS (SELECT e AS qe FROM v WHERE doc_idx = 0) SELECT title, cluster_id, round(dist, 6) AS dist FROM (SELECT *, round({_EUCLID.format('e', 'qe')}, 9) AS dist FROM v, q ORDER BY dist, doc_idx LIMIT 10) WHERE title <> 'Vec_0'")
def indexed_topic_lookup(spark, d):
    """knn_topic_lookup on the stored index, which reads only the cells within the tenth distance."""
    v = vectors(spark, d)
    index = cells.Index.build(v, work_dir(spark, "vector-index"), 64)
    return index.nearest(vector_of(v, 0), 10).filter("title <> 'Vec_0'").select("title", "cluster_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {_V} SELECT x.doc_idx, y.doc_idx AS other, round(round(1 - {_COS.format('x.e', 'y.e')}, 9), 6) AS dist, CAST(row_number() OVER (PARTITION BY x.doc_idx ORDER BY round(1 - {_COS.format('x.e', 'y.e')}, 9), y.doc_idx) AS INTEGER) AS rank FROM v x JOIN v y ON x.doc_idx <> y.doc_idx QUALIFY rank <= 5")
def neighbor_graph(spark, d):
    """The five nearest others of every vector, by cells."""
    return cells.neighbor_graph(vectors(spark, d), 5, 256).select("doc_idx", "other", F.round("dist", 6).alias("dist"), "rank")


@query()
def embedding_map_2d(spark, d):
    """Places are found by gradient steps, which SQL can't repeat; tests hold trustworthiness against that of principal
    components."""
    v = vectors(spark, d)
    return layout.map_2d(v).join(v.select("doc_idx", "title", "cluster_id"), "doc_idx").select("title", "cluster_id", "x", "y")


_SETS = ", ".join(f"'{w}'" for w in fulltext.STOP)
_STEM = "CASE WHEN w LIKE '%ies' THEN CASE WHEN w LIKE '%eies' OR w LIKE '%aies' THEN w ELSE w[:-4] || 'y' END WHEN w LIKE '%es' THEN CASE WHEN w LIKE '%aes' OR w LIKE '%ees' OR w LIKE '%oes' THEN w ELSE w[:-2] END WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
_PLACES = f"""{_A}, words AS (SELECT doc_idx, title, regexp_extract_all(lower(title || ' ' || raw_text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM a),
one AS (SELECT doc_idx, title, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM words),
hit AS (SELECT doc_idx, title, {_STEM} AS term, least(place, 16383) AS p, row_number() OVER (PARTITION BY doc_idx, {_STEM} ORDER BY place) AS n FROM one WHERE w NOT IN ({_SETS}))"""
_TWO = "x AS (SELECT * FROM hit WHERE term IN ('tion', 'ment') AND n <= 255)"
_PAIR = "1 - exp(sum(ln(1 - sqrt(0.1 * 0.1 * CASE WHEN abs(s.p - t.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(s.p - t.p) / 1.5 - 2)) END))))"


@query(f"WITH {_PLACES}, {_TWO}, r AS (SELECT s.doc_idx, any_value(s.title) AS title, round(greatest(1e-20, {_PAIR}), 9) AS rank FROM x s JOIN x t ON s.doc_idx = t.doc_idx AND s.term = 'tion' AND t.term = 'ment' AND s.p <> t.p GROUP BY 1) SELECT title, rank FROM r ORDER BY rank DESC, doc_idx LIMIT 20")
def full_text_rank(spark, d):
    """Documents with both words, by how near one another they stand; plurals count as singulars."""
    return fulltext.search(articles(spark, d), "the tions and ment", 20, "plural").select("title", "rank")


@query(f"WITH {_PLACES}, r AS (SELECT doc_idx, any_value(title) AS title, round(0.1 * sum(1.0 / (n * n)) / 1.64493406685, 9) AS rank FROM hit WHERE term = 'tion' AND n <= 255 GROUP BY 1) SELECT title, rank FROM r ORDER BY rank DESC, doc_idx LIMIT 20")
def full_text_rank_one_word(spark, d):
    """The same search on a stored index, for one word."""
    a = articles(spark, d)
    path = work_dir(spark, "full-text")
    fulltext.store(fulltext.build(a, stemmer="plural"), path, "plural")
    return fulltext.Stored(spark, path).search("tion of the", 20, a.select("doc_idx", "title")).select("title", "rank")


@query(f"WITH RECURSIVE {_V}, {_L}, {_E1}, p AS (SELECT ['Vec_0'] AS way UNION ALL SELECT list_append(way, dst) FROM p JOIN l1 ON src = way[-1] WHERE len(way) < 5) SELECT array_to_string(way, ' > ') AS way, len(way) AS nodes FROM p WHERE way[-1] = 'Vec_31' ORDER BY nodes, list_reverse(way) LIMIT 1")
def graph_stored_path(spark, d):
    """A shortest path over the stored adjacency of the links, searched from both ends."""
    v, path = vectors(spark, d), work_dir(spark, "adjacency")
    graph.write_adjacency(graph.link_edges(v, links(v)), path)
    way = graph.stored_path(spark, path, "Vec_0", "Vec_31")
    return spark.createDataFrame([(" > ".join(way), len(way))], "way string, nodes long")


@query()
def ward_clusters(spark, d):
    """Ten clusters by Ward's method; tests hold them against the least distance each time."""
    return clustering.ward(vectors(spark, d), 10)


_LEMMAS = f"{_A}, {_COUNTS}, words AS (SELECT DISTINCT term AS w FROM c), lem AS ({lemma.rules_sql('words')})"


@query(f"WITH {_LEMMAS} SELECT w AS term, lemma FROM lem")
def lemma_table(spark, d):
    """The corpus's keywords whose lemma is another word; candidates are checked against the keywords themselves."""
    return lemma.lemma_table(keywords.token_counts(articles(spark, d)).select("term"))


@query(f"WITH {_LEMMAS}, m AS (SELECT cluster_id, coalesce(lemma, term) AS term, sum(n) AS n FROM c LEFT JOIN lem ON w = term GROUP BY 1, 2), s AS (SELECT m.cluster_id, m.term, round(n / total * ln(k / cf), 9) AS score FROM m JOIN (SELECT cluster_id, sum(n) AS total FROM m GROUP BY 1) USING (cluster_id) JOIN (SELECT term, count(*) AS cf FROM m GROUP BY 1) USING (term), (SELECT count(DISTINCT cluster_id) AS k FROM m)) SELECT cluster_id, term, score, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS INT) AS rank FROM s QUALIFY rank <= 20")
def ctfidf_lemmas(spark, d):
    """Keywords of clusters by lemma. The counts serve twice, so they are written."""
    path = work_dir(spark, "token-counts")
    keywords.token_counts(articles(spark, d)).write.parquet(path)
    counts = spark.read.parquet(path)
    return keywords.ctfidf(lemma.lemmatized_counts(counts, lemma.lemma_table(counts.select("term")), ["cluster_id"]))


_SAMPLED = f"{_G}, i AS (SELECT title FROM v WHERE cluster_id = 3 ORDER BY md5(title || '42'), title LIMIT 100), o AS (SELECT title FROM (SELECT DISTINCT dst AS title FROM g WHERE layer = 3 AND src IN (FROM i) AND dst NOT IN (FROM i)) ORDER BY md5(title || '42'), title LIMIT 50), k AS (SELECT title, true AS inside FROM i UNION ALL SELECT title, false FROM o)"


def _view(spark, d):
    v = vectors(spark, d)
    return graph.cluster_view(v, links(v), 3, 0.3)


@query(f"WITH {_SAMPLED} SELECT src, dst, layer, weight, type FROM g WHERE src IN (FROM i) AND dst IN (SELECT title FROM k)")
def graph_cluster_view(spark, d):
    """The edges of a cluster's view: samples of 100 of its nodes and 50 neighbours, found without the graph."""
    return _view(spark, d)[1]


@query(f"WITH {_SAMPLED} SELECT title, inside, cluster_id FROM k JOIN v USING (title)")
def graph_cluster_view_nodes(spark, d):
    return _view(spark, d)[0].select("title", "inside", "cluster_id")


@query(_HYBRID.format(k=10) + ", f AS (SELECT title, round(sum(1 / (60 + r - 1)), 9) AS score, CAST(min(r) - 1 AS INT) AS best_rank, min((side, r)) AS seen FROM (SELECT *, 0 AS side FROM sem UNION ALL SELECT *, 1 FROM kw) GROUP BY 1) SELECT title, score, best_rank, CAST(row_number() OVER (ORDER BY score DESC, seen) - 1 AS INT) AS position FROM f ORDER BY score DESC, seen LIMIT 10")
def rrf_first_seen(spark, d):
    """Hybrid search whose ties keep the order in which titles were first seen."""
    return search.rrf_first_seen(*_sides(spark, d, 10, 0))


def _folders(spark, sides: list[dict]) -> list[str]:
    out = []
    for tables in sides:
        out.append(work_dir(spark, "run"))
        for name, df in tables.items():
            df.write.parquet(f"{out[-1]}/{name}")
    return out


_EVOLVED = ", ".join(f"{c}" for c in ("birth_count", "death_count", "stable_count", "avg_size_change_pct", "std_size_change_pct"))


@query(f"SELECT 'stability_' || metric AS metric, value FROM (UNPIVOT (SELECT CAST(ari AS DOUBLE) AS ari, CAST(nmi AS DOUBLE) AS nmi, CAST(same_ratio AS DOUBLE) AS same_ratio, CAST(overlap AS DOUBLE) AS overlap FROM ({SQL['stability_metrics']})) ON ari, nmi, same_ratio, overlap INTO NAME metric VALUE value) UNION ALL SELECT 'stability_evolution_' || metric, value FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _EVOLVED.split(', '))} FROM ({SQL['evolution_totals']})) ON {_EVOLVED} INTO NAME metric VALUE value)")
def stability_run(spark, d):
    """The metric rows that a stability run over two folders logs."""
    v = vectors(spark, d)
    now = V.nearest_center(v, V.centroid_arrays(v)).select("title", F.col("label").alias("cluster_id"))
    b, c = _summary_halves(spark, d)
    base, current = _folders(spark, [{"assignments": v.select("title", "cluster_id"), "summaries": b}, {"assignments": now, "summaries": c}])
    target = work_dir(spark, "metrics")
    checks.run_stability(spark, base, current, "run", target)
    return spark.read.parquet(target).select("metric", "value")


@query()
def drift_run(spark, d):
    """The metric rows that a drift run logs; p-values of Kolmogorov and Smirnov's test aren't SQL's. Tests hold the figures
    against those of drift_metrics."""
    sides = []
    for v, a in zip(_halves(vectors(spark, d)), _halves(articles(spark, d))):
        sides.append({"embeddings": v, "articles": a.withColumnRenamed("raw_text", "cleaned_text"), "assignments": a.select(F.concat(F.lit("T"), F.floor(F.col("doc_idx") / 2).cast("string")).alias("title"), "cluster_id")})
    base, current = _folders(spark, sides)
    target = work_dir(spark, "metrics")
    checks.run_drift(spark, base, current, "run", target, save_baseline=False)
    return spark.read.parquet(target).select("metric", "value")
