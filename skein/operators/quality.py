"""Clustering quality: coherence, alignment, diversity, silhouette, Davies-Bouldin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import centroid_arrays, cosine, euclidean, few, normalize
from . import blocks


def coherence(v: DataFrame) -> DataFrame:
    """Mean pairwise cosine per cluster of two or more, then over clusters; one aggregate by |sum of unit vectors|^2 instead of pairs."""
    unit = v.select("cluster_id", F.posexplode(normalize(F.col("embedding"))).alias("pos", "x"))
    sums = unit.groupBy("cluster_id", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n")).filter("n >= 2")
    return per.agg(F.round(F.avg((F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1))), 6).alias("coherence"), F.count("*").alias("n_clusters"))


def alignment(docs: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of category sets per cluster, then over clusters.

    Documents with equal sets are counted together first, so pairs are of distinct sets, not of documents."""
    sets = docs.filter("categories is not null").select("cluster_id", F.array_sort(F.array_distinct("categories")).alias("c")).groupBy("cluster_id", "c").agg(F.count("*").alias("n"))
    a, b = (sets.select("cluster_id", F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    union = F.size(F.array_union("ca", "cb"))
    pairs = a.join(b, "cluster_id").filter("ca <= cb").withColumn("u", union).filter("u > 0")
    times = F.when(F.col("ca") == F.col("cb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    per = pairs.withColumn("t", times).groupBy("cluster_id").agg(F.sum(F.col("t") * F.size(F.array_intersect("ca", "cb")) / F.col("u")).alias("s"), F.sum("t").alias("t")).filter("t > 0")
    return per.agg(F.round(F.avg(F.col("s") / F.col("t")), 6).alias("alignment"))


def diversity(centers: DataFrame) -> DataFrame:
    """reference_compatible: 1 - (sum of cosine distances - n) / (n (n - 1)); corrected: their mean. Centers, not rows, are paired."""
    a, b = (centers.select(F.col("cluster_id").alias(f"i{x}"), F.col("center").alias(f"c{x}")) for x in "ab")
    d = a.crossJoin(few(b)).select("ia", F.when(F.col("ia") == F.col("ib"), 0.0).otherwise(1 - cosine(F.col("ca"), F.col("cb"))).alias("d"))
    d = d.agg(F.sum("d").alias("s"), F.countDistinct("ia").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return d.select(F.round(1 - (F.col("s") - F.col("n")) / pairs, 6).alias("reference_compatible"), F.round(F.col("s") / pairs, 6).alias("corrected"))


def diversity_of(centers: DataFrame) -> DataFrame:
    """The reference-compatible form alone, null for fewer than two centers."""
    n = centers.count()
    return diversity(centers).select(F.when(F.lit(n >= 2), F.col("reference_compatible")).alias("diversity"))


def keyword_vectors(summaries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """cluster_id and embedding of each keyword; embed: an expression of the word, built-in or an Arrow function."""
    return summaries.select("cluster_id", F.explode("keywords").alias("term")).select("cluster_id", embed(F.col("term")).alias("embedding"))


def keyword_coherence(summaries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Mean pairwise cosine of each cluster's keywords (two or more), then over clusters."""
    return coherence(keyword_vectors(summaries, embed))


def keyword_diversity(summaries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Diversity of the clusters' mean keyword vectors."""
    return diversity(centroid_arrays(keyword_vectors(summaries, embed)))


def semantic_metrics(summaries: DataFrame, docs: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], coherence_method: str = "keywords", diversity_method: str = "centroids") -> DataFrame:
    """One row of the metrics that the methods name: keywords, articles or both; centroids, keywords or both. A metric that
    can't be told (too few clusters or members) is null."""
    parts = []
    if coherence_method in ("keywords", "both"):
        parts.append(keyword_coherence(summaries, embed).select(F.col("coherence").alias("topic_coherence_keywords")))
    if coherence_method in ("articles", "both"):
        parts.append(coherence(vectors).select(F.col("coherence").alias("topic_coherence_articles")))
    parts.append(alignment(docs).select(F.col("alignment").alias("category_alignment")))
    if diversity_method in ("centroids", "both"):
        parts.append(diversity(centroid_arrays(vectors)).select(F.col("reference_compatible").alias("cluster_diversity_centroids")))
    if diversity_method in ("keywords", "both"):
        parts.append(keyword_diversity(summaries, embed).select(F.col("reference_compatible").alias("cluster_diversity_keywords")))
    out = parts[0]
    for x in parts[1:]:  # each is one row
        out = out.crossJoin(x)
    return out


def sampled(v: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, the least by a digest of their number and the seed: a sample that reruns, and SQL, repeat."""
    return v.orderBy(F.md5(F.concat(F.col("doc_idx").cast("string"), F.lit(f":{seed}")).cast("binary")), "doc_idx").limit(n)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product; those that it would blur, of rows that nearly agree, by differences."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)
    d = square - 2 * x @ y.T
    a, b = np.nonzero(d < 1e-6 * square)
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    for at in range(0, len(a), 1 << 14):
        p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        d[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(1))
    return d


def silhouette(v: DataFrame, sample: int | None = 500, block: int = 2048) -> DataFrame:
    """Euclidean silhouette of a hash-ordered sample, or of all rows (None).

    Blocks of rows meet all blocks; a task adds up, for a block at a time, its rows' distances to each cluster, so that
    neither rows nor distances are shuffled, but one row of sums for each block and part of the others. Names and sizes of
    the clusters travel with the functions; the more there are, the smaller are the blocks.
    """
    some = (sampled(v, sample) if sample else v).filter("embedding is not null").select("doc_idx", "cluster_id", "embedding")
    found = some.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy("cluster_id").collect()  # a row for each cluster
    names, sizes = np.array([r["cluster_id"] for r in found]), np.array([r["n"] for r in found], float)
    of = blocks.packed(some, "cluster_id", unit=False, block=max(64, min(block, (1 << 22) // max(1, len(names)))))

    def own(b: blocks.Block) -> np.ndarray:
        """The place of each row's cluster, -1 for none."""
        c = b.column("cluster_id")
        there = c.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(there), -1)
        out[there] = np.searchsorted(names, c.drop_null().to_numpy(zero_copy_only=False))
        return out

    def sums(pairs: Iterator[tuple[blocks.Block, blocks.Block]]) -> Iterator[pa.RecordBatch]:
        now, total, mine = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now.number]), pa.array([mine.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["blk", "own", "s"])

        for left, right in pairs:
            if now is None or now.number != left.number:
                if now is not None:
                    yield out()
                now, total, mine = left, np.zeros((len(left.ids), len(names))), own(left).astype(np.int64)
            other = own(right)
            order = np.argsort(other, kind="stable")
            order = order[other[order] >= 0]
            if not len(order):
                continue
            labels, first = np.unique(other[order], return_index=True)
            y = right.x[order]
            for at in range(0, len(left.ids), blocks.AT_ONCE):
                total[at : at + blocks.AT_ONCE, labels] += np.add.reduceat(_distances(left.x[at : at + blocks.AT_ONCE], y), first, axis=1)
        if now is not None:
            yield out()

    def scores(g: pa.Table) -> pa.Table:
        mine = np.frombuffer(g.column("own")[0].as_buffer(), np.int64)
        s = np.zeros((len(mine), len(names)))
        for part in g.column("s"):
            s += np.frombuffer(part.as_buffer()).reshape(s.shape)
        row, c = np.arange(len(mine)), np.maximum(mine, 0)
        n = np.where(mine >= 0, sizes[c], 0) if len(names) else np.zeros(len(mine))
        if not len(names):
            return pa.table({"s": pa.array([0.0]), "n": pa.array([len(mine)])})
        a = s[row, c] / np.maximum(n - 1, 1)
        mean = s / sizes
        mean[row, c] = np.inf
        nearest = mean.min(1)
        top = np.maximum(a, np.where(np.isfinite(nearest), nearest, a))
        score = np.where((n > 1) & (top > 0), (nearest - a) / np.where(top > 0, top, 1), 0.0)
        known = np.isfinite(score)  # one cluster alone has no other
        return pa.table({"s": pa.array([score[known].sum()]), "n": pa.array([int(known.sum())])})

    part = blocks.met(of, of, sums, "blk long, own binary, s binary")
    row = part.groupBy("blk").applyInArrow(scores, "s double, n long")
    return row.agg(F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("silhouette"))


def davies_bouldin(v: DataFrame) -> DataFrame:
    centers = centroid_arrays(v)
    spread = v.join(few(centers), "cluster_id").groupBy("cluster_id").agg(F.avg(euclidean(F.col("embedding"), F.col("center"))).alias("s")).join(centers, "cluster_id")
    a, b = (spread.select(F.col("cluster_id").alias(f"i{x}"), F.col("s").alias(f"s{x}"), F.col("center").alias(f"c{x}")) for x in "ab")
    worst = a.crossJoin(few(b)).filter("ia <> ib").groupBy("ia").agg(F.max((F.col("sa") + F.col("sb")) / euclidean(F.col("ca"), F.col("cb"))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))
