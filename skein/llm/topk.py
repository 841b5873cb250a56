"""Exact top-k search by inner product: block-at-a-time pruning over document ranges.

Vectors become whole numbers; a component is a term, with its sign: a query takes part with |q| of each. Vectors are put
in an order in which neighbours are alike (bits of their leading principal components, interleaved; a sample of bounded
size fits the axes) and cut into blocks of BLOCK rows. A block's forward index is its matrix; its term maxima are the
largest and the least value of each component, so that

    bound(q, block) = sum over components of max(q * largest, q * least)

is no less than any score in it. Blocks lie together in shards of bounded size, one row each in the shared folder.

A query first searches its own shard: blocks in falling order of bounds, until the next bound is below the k-th score so
far. That k-th score goes along to the other shards whose own bound isn't below it (shards' maxima are kept in a small
table, in chunks), where the search goes on in the same way. Queries that want a shard travel in batches, past its
blocks, which one task holds at a time; the k best of each shard's answers meet by query. Nothing is broadcast, no group
is larger than a shard.

Scores are exact: products of matrices in double precision while every sum fits 53 bits, otherwise whole numbers of any
size, cut off at the ends of a long. Pruning takes place if bounds fall below the k-th score, as with vectors in
clusters; with vectors at random in many dimensions few do, and then every pair is scored, in blocks.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id.
Only vectors of one length are compared; empty ones score 0 with one another. Every row whose id `every` divides is a
query, repeated rows too, each with its own results; a query's own row is no candidate, another row of its id is. Values
beyond a double after scaling count as the largest double. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, remove, table, trimmed, written

BLOCK = 256
#: Rows and bytes (of doubles) of a shard at most; queries of a batch at most.
SHARD, SHARD_BYTES, BATCH = 1 << 15, 16 << 20, 1024
#: Rows that fit the axes of the order at most, axes, and bits of each.
SAMPLE, AXES, DEPTH = 2048, 8, 7
#: Bytes of shards' maxima that travel in one row, about.
CHUNK_BYTES = 1 << 20
_LIMIT = float(np.finfo(float).max)
_LONG = (1 << 63) - 1


def whole(batch: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and floor(scale * x) of the vectors that take part, by length."""
    lengths = batch.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == d)
        x = batch.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), d)
        fine = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            yield at[fine], np.clip(np.floor(scale * x[fine]), -_LIMIT, _LIMIT)


class Order:
    """Places alike vectors near one another: interleaved bits of quantiles of the leading principal components.

    Fitted on a sample for its most frequent length; vectors of other lengths are ordered by id alone.
    """

    def __init__(self, sample: list[np.ndarray]) -> None:
        sizes = [len(x) for x in sample]
        self.d = max(set(sizes), key=sizes.count) if sizes else 0
        x = np.array([v for v in sample if len(v) == self.d]).reshape(sizes.count(self.d), self.d)
        self.size = max(1.0, np.abs(x).max(initial=0))
        x = x / self.size
        self.axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:AXES].T if len(x) > 1 and self.d else np.zeros((self.d, 0))
        self.cuts = np.quantile(x @ self.axes, np.arange(1, 1 << DEPTH) / (1 << DEPTH), axis=0) if self.axes.size else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        key = np.zeros(len(x), np.int64)
        if x.shape[1] != self.d or self.cuts is None:
            return key
        with np.errstate(over="ignore", invalid="ignore"):
            y = (x / self.size) @ self.axes
        codes = np.stack([np.searchsorted(self.cuts[:, j], y[:, j]) for j in range(y.shape[1])], 1)
        for bit in range(DEPTH - 1, -1, -1):
            for j in range(codes.shape[1]):
                key = key << 1 | codes[:, j] >> bit & 1
        return key


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers in the least type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = next((k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max), "float64")
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, d).astype(float)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs."""
    with np.errstate(over="ignore"):
        plain = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 1 << 53
    if plain:
        return (q @ x.T).astype(np.int64)
    rows, others = ([[int(v) for v in row] for row in m.tolist()] for m in (q, x))
    return np.array([[min(_LONG, max(-_LONG, sum(a * b for a, b in zip(r, o)))) for o in others] for r in rows], np.int64).reshape(len(q), len(x))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of each query in each block exceeds; rounding is allowed for."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
        out = out + size * 1e-12
    return np.where(np.isnan(out), np.inf, out)


class Shard:
    """The blocks of one shard: ids and forward indexes, and their term maxima."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.begins = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(x, self.begins) if x.size else np.zeros((len(self.begins), x.shape[1]))
        self.low = np.minimum.reduceat(x, self.begins) if x.size else self.high
        self.scored = 0

    def search(self, q: np.ndarray, k: int, least: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of each query's k best rows of score least or more (a smaller id first among equals), by
        query; and least, raised to the k-th score where k were found. own: places of the queries' own rows, left out."""
        n = len(q)
        least = least.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        bound = bounds(q, self.high, self.low)
        turn = np.argsort(-bound, 1, kind="stable")
        open_ = np.arange(n)
        for step in range(len(self.begins)):
            block = turn[open_, step]
            go = bound[open_, block] >= least[open_]
            open_, block = open_[go], block[go]
            if not len(open_):
                break
            for b in np.unique(block).tolist():
                who = open_[block == b]
                first = int(self.begins[b])
                s = scores(q[who], self.x[first : first + BLOCK])
                self.scored += len(who)
                hit = s >= least[who][:, None]
                if own is not None:
                    mine = own[who] - first
                    inside = np.flatnonzero((mine >= 0) & (mine < s.shape[1]))
                    hit[inside, mine[inside]] = False
                for i in np.flatnonzero(hit.any(1)).tolist():
                    at = np.flatnonzero(hit[i])
                    place, score = (np.concatenate(z) for z in zip(best[who[i]], (at + first, s[i, at])))
                    if len(place) > k:
                        keep = np.lexsort((self.ids[place], -score))[:k]
                        place, score = place[keep], score[keep]
                    best[who[i]] = place, score
                    if len(place) == k:
                        least[who[i]] = max(least[who[i]], score.min())
        return np.repeat(np.arange(n), [len(p) for p, _ in best]), np.concatenate([p for p, _ in best] or [[]]).astype(np.int64), np.concatenate([s for _, s in best] or [[]]).astype(np.int64), least


_SHARDS = "shard long, d int, n int, ids binary, kind string, x binary, high array<double>, low array<double>"


def shards(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """The written forward index: a row for each shard."""
    spark = vectors.sparkSession
    plain = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sample = plain.filter("v is not null").withColumn("h", F.xxhash64("id")).orderBy("h").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    order = Order([row for _, x in whole(sample, scale) for row in x])

    @trimmed
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in whole(b.column(1), scale):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(order(x)), lists], ["id", "d", "key", "v"])

    @trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; a shard ends when it is full or the length changes."""
        number, held, d = TaskContext.get().partitionId() << 24, [], -1

        def emit() -> pa.RecordBatch:
            ids, x = (np.concatenate(z) for z in zip(*held))
            kind, data = packed(x)
            values = [number, d, len(ids), ids.tobytes(), kind, data, x.max(0).tolist(), x.min(0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())))], [c.split()[0] for c in _SHARDS.split(", ")])

        for b in batches:
            ids, sizes, flat = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).flatten().to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(ids)]
            begin = 0
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                size = int(sizes[first])
                x = flat[begin : begin + (last - first) * size].reshape(last - first, size)
                begin += (last - first) * size
                most = max(1, min(SHARD, SHARD_BYTES // (8 * max(1, size))))
                at = 0
                while at < len(x):
                    room = most - sum(len(i) for i, _ in held)
                    if held and (d != size or room <= 0):
                        yield emit()
                        number, held, room = number + 1, [], most
                    d = size
                    held.append((ids[first + at : first + min(len(x), at + room)], x[at : at + room]))
                    at += room
        if held:
            yield emit()

    rows = plain.mapInArrow(prepare, "id long, d int, key long, v array<double>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // SHARD))
    ranged = rows.repartitionByRange(parts, "d", "key", "id").sortWithinPartitions("d", "key", "id")
    return written(ranged.mapInArrow(pack, _SHARDS), "topk-shards")


_FOUND = "found array<struct<query:long,query_id:long,vec_id:long,score:long>>"
_FOUND_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")]))


def _found(query: np.ndarray, query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (query, query_id, vec_id, score)], ["query", "query_id", "vec_id", "score"])
    return pa.ListArray.from_arrays(pa.array([0, len(query)], pa.int32()), rows)


_BATCH = "shard long, d int, n int, ids binary, query binary, kind string, x binary, least binary"
_NAMES = [c.split()[0] for c in _BATCH.split(", ")]


def _batch(shard: int, d: int, ids: np.ndarray, query: np.ndarray, q: np.ndarray, least: np.ndarray) -> list:
    return [shard, d, len(ids), ids.tobytes(), query.tobytes(), *packed(q), least.tobytes()]


def _arrays(values: list) -> list[pa.Array]:
    return [pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()))]


def _at_home(k: int, every: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each shard, with their k-th score so far, and what they found there."""
        for b in batches:
            for r in b.to_pylist():
                here = Shard(np.frombuffer(r["ids"], np.int64), unpacked(r["kind"], r["x"], r["d"], r["n"]))
                places = np.flatnonzero(here.ids % every == 0)
                for first in range(0, len(places), BATCH):
                    own = places[first : first + BATCH]
                    q = here.x[own]
                    who, place, score, least = here.search(q, k, np.full(len(q), -_LONG), own)
                    query = (np.int64(r["shard"]) << 15) + own
                    yield pa.RecordBatch.from_arrays([*_arrays(_batch(r["shard"], r["d"], here.ids[own], query, q, least)), _found(query[who], here.ids[own][who], here.ids[place], score)], [*_NAMES, "found"])

    return run


@trimmed
def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each batch that a shard of the chunk may hold answers for, as a batch for that shard."""
    for b in batches:
        for r in b.to_pylist():
            q = unpacked(r["kind"], r["x"], r["d"], r["n"])
            ids, query, least = (np.frombuffer(r[c], np.int64) for c in ("ids", "query", "least"))
            others = [s for s in r["shards"] if s["d"] == r["d"] and s["shard"] != r["shard"]]
            if not others:
                continue
            reach = bounds(q, np.array([s["high"] for s in others]).reshape(len(others), -1), np.array([s["low"] for s in others]).reshape(len(others), -1)) >= least[:, None]
            for i, s in enumerate(others):
                go = reach[:, i]
                if go.any():
                    yield pa.RecordBatch.from_arrays(_arrays(_batch(s["shard"], r["d"], ids[go], query[go], q[go], least[go])), _NAMES)


def _away(k: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's row comes first, then the batches that want it."""
        here = None
        for b in batches:
            for r in b.to_pylist():
                x = unpacked(r["kind"], r["x"], r["d"], r["n"])
                ids = np.frombuffer(r["ids"], np.int64)
                if r["query"] is None:
                    here = Shard(ids, x)
                    continue
                query, least = (np.frombuffer(r[c], np.int64) for c in ("query", "least"))
                who, place, score, _ = here.search(x, k, least)
                if len(who):
                    yield pa.RecordBatch.from_arrays([_found(query[who], ids[who], here.ids[place], score)], ["found"])

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose id `every` divides."""
    spark: SparkSession = lean(vectors.sparkSession)
    index = shards(vectors, id_col, vector_col, scale)
    home = written(index.select("shard", "d", "n", "ids", "kind", "x").mapInArrow(_at_home(k, every), f"{_BATCH}, {_FOUND}"), "topk-home")

    # batches are dealt by chunk of maxima and a salt; every salt has all chunks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = index.agg(F.count("*").alias("n"), F.coalesce(F.sum(16 * F.col("d") + 64), F.lit(0)).alias("bytes")).first()
    chunks = 1 + sizes.bytes // CHUNK_BYTES
    maxima = index.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks))).groupBy("chunk").agg(F.collect_list(F.struct("shard", "d", "high", "low")).alias("shards"))
    salted = maxima.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asked = home.drop("found").withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("long")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    wanted = asked.join(salted, ["chunk", "salt"]).drop("chunk", "salt").mapInArrow(_wanted, _BATCH)

    none = F.lit(None).cast("binary")
    both = index.select("shard", "d", "n", "ids", none.alias("query"), "kind", "x", none.alias("least")).unionByName(wanted)
    met = both.withColumn("asks", F.col("query").isNotNull()).repartition(max(parts, sizes.n), "shard").sortWithinPartitions("shard", "asks").drop("asks")
    away = written(met.mapInArrow(_away(k), _FOUND), "topk-away")

    every_one = home.select("found").unionByName(away).select(F.explode("found").alias("f")).select("f.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best partners of every 20th vector among all others."""
    return search(table(spark, sf_dir, "embeddings"))


#: All pairs; list_inner_product stays exact, as every sum is far below 2**53.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
