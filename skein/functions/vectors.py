"""Vector functions, and joins of vectors by similarity."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(v: DataFrame) -> DataFrame:
    """cluster_id, pos, value: one partial sum for each cluster and dimension leaves a task."""
    return v.select("cluster_id", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("value"))


def centroid_arrays(v: DataFrame) -> DataFrame:
    c = centroids(v).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("c"))
    return c.select("cluster_id", F.transform("c", lambda x: x["value"]).alias("center"))


def dealt(v: DataFrame, block: int, *columns: str) -> DataFrame:
    """i, j, left, right and the columns: each row once for every pair of blocks that its own is in.

    Blocks are dealt by hash, about `block` rows each, so ids may be sparse; partners are exploded and the groups (i, j)
    formed by equality.
    """
    n = max(1, -(-v.count() // block))
    own = v.withColumn("b", F.pmod(F.xxhash64("doc_idx"), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i, j = F.least("b", "o"), F.greatest("b", "o")
    return own.select(i.alias("i"), j.alias("j"), (F.col("b") == i).alias("left"), (F.col("b") == j).alias("right"), *columns)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1)


def compare_blocks(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs a < b with cosine >= threshold of a group (i, j) of dealt rows, by one matrix product."""

    def compare(g: pa.Table) -> pa.Table:
        x, ids = _matrix(g.column("embedding")), g.column("doc_idx").to_numpy()
        x = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
        left, right = (np.flatnonzero(g.column(c).to_numpy()) for c in ("left", "right"))
        a, b = np.nonzero((sim := x[left] @ x[right].T) >= threshold)
        s, a, b = sim[a, b], ids[left][a], ids[right][b]
        keep = a < b if g.column("i")[0] == g.column("j")[0] else a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": s[keep]})

    return compare


def similar_pairs(v: DataFrame, threshold: float = 0.7, block: int = 512) -> DataFrame:
    """a < b and sim for all pairs with cosine >= threshold, exactly.

    Vectors are dealt out as pairs of blocks, each compared by one matrix product in Arrow batches; only qualifying pairs
    leave a task. The comparisons are all pairs by definition of an exact join without labels.
    """

    both = dealt(v.filter("embedding is not null"), block, "doc_idx", "embedding")
    return both.groupBy("i", "j").applyInArrow(compare_blocks(threshold), "a long, b long, sim double")


def small(df: DataFrame, rows: int = 4096) -> bool:
    """Whether a frame has few enough rows to be sent to every task; looked up before each forced broadcast."""
    return df.limit(rows + 1).count() <= rows


def few(df: DataFrame, rows: int = 4096) -> DataFrame:
    """df, marked for broadcast if it is small; beyond, Spark chooses the join."""
    return F.broadcast(df) if small(df, rows) else df


def top_k(v: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows to one vector, with dist; ties by doc_idx."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = 1 - cosine(F.col("embedding"), q) if metric == "cosine" else euclidean(F.col("embedding"), q)
    return v.withColumn("dist", F.round(dist, 9)).orderBy("dist", "doc_idx").limit(k)


def nearest_center(v: DataFrame, centers: DataFrame, *keep: str) -> DataFrame:
    """doc_idx, title, the label of the nearest center, and the columns to keep; ties go to the least label.

    Few centers travel as one array and the minimum is taken in the row, without a shuffle; many are joined and reduced.
    """
    named = centers.select(F.col("cluster_id").alias("label"), "center")
    rows = v.select("doc_idx", "title", "embedding")
    if small(named):
        all_of = F.broadcast(named.agg(F.collect_list(F.struct("label", "center")).alias("all")))
        nearest = F.array_min(F.transform("all", lambda c: F.struct(F.round(euclidean(F.col("embedding"), c["center"]), 9).alias("d"), c["label"].alias("label"))))
        return rows.crossJoin(all_of).select("doc_idx", "title", nearest["label"].alias("label"), *keep)
    best = rows.crossJoin(named).groupBy("doc_idx", "title").agg(F.min(F.struct(F.round(euclidean(F.col("embedding"), F.col("center")), 9), "label")).alias("m"), *[F.first(c).alias(c) for c in keep])
    return best.select("doc_idx", "title", F.col("m.label").alias("label"), *keep)


class Embedder(Protocol):
    """What turns texts into vectors; one is made in each Python worker."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A signed hashed bag of words, scaled to length 1: the offline default. Each distinct word is hashed once a batch."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        words, which = np.unique(np.array([w for s in split for w in s], object), return_inverse=True) if any(split) else ([], np.zeros(0, int))
        h = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
        row = np.repeat(np.arange(len(split)), [len(s) for s in split])
        out = np.zeros(len(split) * self.dim)
        if len(h):
            np.add.at(out, row * self.dim + (h % self.dim)[which], np.where(h >> 31, 1.0, -1.0)[which])
        out = out.reshape(len(split), self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def letter_embedding(term: Column) -> Column:
    """Counts of the letters a to z: an embedding of words that is an expression, for where no model is at hand."""
    return F.transform(F.array(*[F.lit(chr(c)) for c in range(97, 123)]), lambda x: (F.length(term) - F.length(F.replace(term, x, F.lit("")))).cast("double"))


def embed(docs: DataFrame, make: Callable[[], Embedder], text_col: str = "raw_text", batch: int = 64) -> DataFrame:
    """doc_idx and embedding of each text (a null is empty), `batch` texts at a time; make() runs once in each worker's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                x = np.asarray(model.encode([t or "" for t in b.column(1).slice(at, batch).to_pylist()]), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, batch), lists], ["doc_idx", "embedding"])

    return docs.select(F.col("doc_idx").cast("long"), text_col).mapInArrow(run, "doc_idx long, embedding array<double>")


def hash_embeddings(docs: DataFrame, text_col: str = "raw_text", dim: int = 384) -> DataFrame:
    return embed(docs, lambda: HashEmbedder(dim), text_col, 2048)


def representatives(v: DataFrame, per_cluster: int = 10) -> DataFrame:
    """The rows nearest to their cluster's center, ranked from 1."""
    near = v.join(few(centroid_arrays(v)), "cluster_id").withColumn("dist", F.round(euclidean(F.col("embedding"), F.col("center")), 9))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("dist", "doc_idx"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_cluster).select("cluster_id", "title", "dist", "rank")
