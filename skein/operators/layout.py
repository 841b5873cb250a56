"""A 2-D map that keeps neighbourhoods: fuzzy weights on the graph of nearest neighbours, and a layout by gradient steps with
negative samples, partition by partition.

Rows start at their principal components. Weights fall off from each row's nearest neighbour on, at a rate that makes them
add up to log2(k), and are merged over both directions. The layout runs in rounds: a round groups rows by block of the
cells (neighbours mostly share one), and each task moves its own rows for some steps along their edges, away from random
rows. Rows of other blocks stand still for the round, at the places they had before it; a pool of POOL rows stands for all
others among the negative samples. Every row has its own k edges only, so that no row and no block is large. Places are
written after each round; reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..session import work_dir
from . import cells
from .quality import sampled

POOL = 2048


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^(2 b)), which is nearest to 1 up to min_dist and to exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):  # Gauss-Newton, damped
        p = d ** (2 * b)
        f = 1 / (1 + a * p)
        j = np.stack([-p * f * f, -a * p * 2 * np.log(d) * f * f], 1)
        step = np.linalg.solve(j.T @ j + 1e-6 * np.eye(2), j.T @ (want - f))
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
    return float(a), float(b)


def fuzzy_weights(dist: np.ndarray) -> np.ndarray:
    """Weights of each row's neighbours from their distances in rising order: exp(-(d - nearest) / s), s such that they add
    up to log2 of their number."""
    near, wanted = dist[:, :1], np.log2(max(2, dist.shape[1]))
    low, high = np.full((len(dist), 1), 1e-12), np.full((len(dist), 1), 1e6)
    for _ in range(64):
        s = np.sqrt(low * high)
        over = np.exp(-(dist - near) / s).sum(1, keepdims=True) > wanted
        low, high = np.where(over, low, s), np.where(over, s, high)
    # equal distances add up to more at any rate: the mean distance bounds s from below
    return np.exp(-(dist - near) / np.maximum(np.sqrt(low * high), 1e-3 * dist.mean(1, keepdims=True) + 1e-12))


def weighted_edges(graph: DataFrame) -> DataFrame:
    """src, dst and w: each row's edges to its neighbours, a + b - a b of the weights that both ends give."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                take = pa.array(np.flatnonzero(sizes == n))
                flat = lists.take(take).flatten()
                w = fuzzy_weights(flat.field("dist").to_numpy().reshape(len(take), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).take(take).to_numpy(), n)), flat.field("other"), pa.array(w.ravel())], ["src", "dst", "a"])

    near = graph.groupBy("doc_idx").agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("near"))  # k each
    out = near.mapInArrow(run, "src long, dst long, a double")
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("b"))
    b = F.coalesce("b", F.lit(0.0))
    return out.join(back, ["src", "dst"], "left").select("src", "dst", (F.col("a") + b - F.col("a") * b).alias("w"))


def _moved(y: np.ndarray, src: np.ndarray, dst: np.ndarray, still: np.ndarray, w: np.ndarray, pool: np.ndarray, total: int, a: float, b: float, rates: np.ndarray, rng: np.random.Generator, negative: int = 5) -> np.ndarray:
    """y after the steps. An edge's far end is row dst of y, or stands still where dst is -1."""
    inside = dst >= 0
    for rate in rates:
        chosen = rng.permutation(np.flatnonzero(rng.random(len(w)) < w))
        for part in np.array_split(chosen, max(1, len(chosen) // max(64, len(y)))):
            if not len(part):
                continue
            s, here = src[part], inside[part]
            far = np.where(here[:, None], y[np.maximum(dst[part], 0)], still[part])
            diff = y[s] - far
            d2 = (diff * diff).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
            g = np.clip(pull[:, None] * diff, -4, 4)
            move = np.zeros_like(y)
            np.add.at(move, s, g)
            np.add.at(move, dst[part][here], -g[here])
            # one draw in proportion to the rows that stand in each place: this block, or the pool for all others
            own = rng.random((len(part), negative)) < len(y) / max(total, 1)
            away = np.where(own[..., None], y[rng.integers(0, len(y), own.shape)], pool[rng.integers(0, len(pool), own.shape)])
            diff = y[s][:, None] - away
            d2 = (diff * diff).sum(2)
            push = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
            np.add.at(move, s, np.clip(push[..., None] * diff, -4, 4).sum(1) * (d2.sum(1) > 0)[:, None])
            y = y + rate * np.clip(move, -4, 4)
    return y


def _round(pool: np.ndarray, rates: np.ndarray, n: int, a: float, b: float, seed: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def step(own: pa.Table, near: pa.Table) -> pa.Table:
        own, near = own.sort_by("doc_idx"), near.sort_by([("src", "ascending"), ("dst", "ascending")])
        ids, src, dst = own.column("doc_idx").to_numpy(), *(near.column(c).to_numpy() for c in ("src", "dst"))
        y, still = (np.stack([t.column(c).to_numpy() for c in names], 1) for t, names in ((own, ("x", "y")), (near, ("dx", "dy"))))
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        rng = np.random.default_rng([*seed, int(ids[0]) & 0xFFFFFFFF])
        y = _moved(y, np.searchsorted(ids, src), np.where(ids[at] == dst, at, -1), still, near.column("w").to_numpy(), pool, n, a, b, rates, rng)
        return pa.table({"doc_idx": ids, "x": y[:, 0], "y": y[:, 1], "blk": own.column("blk")})

    return step


def start(v: DataFrame) -> DataFrame:
    """doc_idx, x and y: principal components of the unit vectors, the largest ten from the middle."""
    f = v.select("doc_idx", array_to_vector("embedding").alias("features"))
    if v.limit(3).count() < 3:
        return v.select("doc_idx", F.col("doc_idx").cast("double").alias("x"), F.lit(0.0).alias("y"))
    xy = PCA(k=2, inputCol="features", outputCol="xy").fit(f).transform(f).select("doc_idx", vector_to_array("xy").alias("xy"))
    m = xy.agg(F.avg(F.col("xy")[0]).alias("mx"), F.avg(F.col("xy")[1]).alias("my"), F.max(F.abs(F.col("xy")[0])).alias("a"), F.max(F.abs(F.col("xy")[1])).alias("b")).first()  # one row
    scale = 10 / max(m.a + abs(m.mx), m.b + abs(m.my), 1e-9)
    # equal rows would move as one: a little noise that reruns repeat
    noise = lambda seed: (F.pmod(F.xxhash64("doc_idx", F.lit(seed)), F.lit(2001)) - 1000) * 1e-6
    return xy.select("doc_idx", ((F.col("xy")[0] - m.mx) * scale + noise(1)).alias("x"), ((F.col("xy")[1] - m.my) * scale + noise(2)).alias("y"))


def map_2d(v: DataFrame, neighbors: int = 15, min_dist: float = 0.1, rounds: int = 10, steps: int = 30, block: int = 2048, seed: int = 42) -> DataFrame:
    """doc_idx, x and y of every row that has a vector. v: doc_idx, embedding."""
    spark = v.sparkSession
    plain = v.filter("embedding is not null")
    n = plain.count()
    k = min(neighbors, n - 1)

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = work_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    unit = plain.select("doc_idx", normalize(F.col("embedding").cast("array<double>")).alias("embedding"))
    if k < 1:
        return unit.select("doc_idx", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    a, b = curve(min_dist)
    rows, _ = cells._unit_rows(plain, 2 * block, seed, block)
    edges = weighted_edges(cells.neighbor_graph(plain, k, min(block, 1024), seed))
    part = rows.select("doc_idx", "blk")
    edges = stored(edges.join(part.withColumnRenamed("doc_idx", "src"), "src"), "map-edges")
    places = stored(start(unit).join(part, "doc_idx"), "map-places")

    for r in range(rounds):
        # POOL rows at most
        pool = np.array([(p["x"], p["y"]) for p in sampled(places, POOL, seed + r).orderBy("doc_idx").collect()])
        rates = 1 - (r * steps + np.arange(steps)) / (rounds * steps)

        ends = places.select(F.col("doc_idx").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
        far = edges.join(ends, "dst").select("src", "dst", "w", "dx", "dy", "blk")
        moved = places.groupBy("blk").cogroup(far.groupBy("blk")).applyInArrow(_round(pool, rates, n, a, b, [seed, r]), "doc_idx long, x double, y double, blk long")
        places = stored(moved, "map-places")
    return places.select("doc_idx", "x", "y")
