"""Blocks of rows, and pairs of them: where all rows meet all others, blocks travel, not copies of rows.

A block is one stored row: the numbers, columns and vectors of about as many rows as asked for. Pairs come from a cross join
that reads the stored blocks again, so nothing is shuffled or copied to disk; the right side is read once for each part of
the left one. A task holds two blocks at a time. The pairs of one left block follow each other, so that what is kept of its
rows may be handed on once for all the right blocks of a task; nothing rests on that order but how many rows leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

BLOCK = 2048
#: Left rows that are compared at once.
AT_ONCE = 256


class Block:
    """A block in a task: its number, its rows' doc_idx in rising order, x (NaN where a vector is null) and other columns."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str) -> None:
        self.of = lambda name: batch.column(f"{side}_{name}")[row]
        self.number = self.of("blk").as_py()
        self.ids = self.of("doc_idx").values.to_numpy()
        self.x = np.frombuffer(self.of("x").as_buffer(), float).reshape(len(self.ids), -1)

    def column(self, name: str) -> pa.Array:
        return self.of(name).values


def _vectors(column: pa.ChunkedArray, unit: bool) -> np.ndarray:
    lists = column.combine_chunks()
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    some = np.asarray(lists.flatten(), float).reshape(there.sum(), -1) if there.any() else np.zeros((0, 0))
    if unit:
        some = some / np.where((n := np.linalg.norm(some, axis=1, keepdims=True)) == 0, 1, n)
    x = np.full((len(there), some.shape[1]), np.nan)
    x[there] = some
    return x


def packed(v: DataFrame, *columns: str, unit: bool = True, block: int = BLOCK, by: Column | None = None) -> DataFrame:
    """blk, doc_idx, x (all vectors as bytes; scaled to length 1 with `unit`) and the columns, one row a block, stored.

    v: doc_idx, embedding, the columns; rows without a number stay out. by: the block of a row, else dealt by hash.
    """
    spark, v = v.sparkSession, v.filter("doc_idx is not null")
    n = max(1, -(-v.count() // block))
    rows = v.select((F.pmod(F.xxhash64("doc_idx"), F.lit(n)) if by is None else by).cast("long").alias("blk"), F.col("doc_idx").cast("long").alias("doc_idx"), F.col("embedding").cast("array<double>").alias("embedding"), *columns)

    def pack(g: pa.Table) -> pa.Table:
        g = g.sort_by("doc_idx")
        v = _vectors(g.column("embedding"), unit)
        plain = ((c, g.column(c).combine_chunks()) for c in ("doc_idx", *columns))
        # elements of lists may be null by Spark's schema
        plain = ((c, x.cast(pa.list_(x.type.value_type)) if pa.types.is_list(x.type) else x) for c, x in plain)
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in plain}
        return pa.table({"blk": g.column("blk").slice(0, 1), "x": pa.array([v.tobytes()], pa.binary()), **lists})

    kinds = dict(rows.dtypes)
    schema = "blk long, x binary, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in ("doc_idx", *columns))
    path = work_dir(spark, "blocks")
    # many files, so that many tasks read them
    rows.repartition(min(max(n, 8), 512), "blk").groupBy("blk").applyInArrow(pack, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def met(left: DataFrame, right: DataFrame, run: Callable[[Iterator[tuple[Block, Block]]], Iterator[pa.RecordBatch]], schema: str, once: bool = False) -> DataFrame:
    """What `run` makes of a task's pairs of blocks. once: left and right are the same blocks, and a pair comes in one order."""
    l, r = (b.select(*[F.col(c).alias(f"{side}_{c}") for c in b.columns]) for b, side in ((left, "l"), (right, "r")))
    pairs = l.crossJoin(r)
    if once:
        pairs = pairs.filter("l_blk <= r_blk")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
        own = None
        for batch in batches:
            numbers = batch.column("l_blk").to_pylist()
            for i, number in enumerate(numbers):
                if own is None or own.number != number:
                    own = Block(batch, i, "l")
                other = Block(batch, i, "r")
                width = max(own.x.shape[1], other.x.shape[1])
                for b in (own, other):  # a block of nulls alone has no width of its own
                    if b.x.shape[1] < width:
                        b.x = np.full((len(b.ids), width), np.nan)
                yield own, other

    return pairs.mapInArrow(lambda batches: run(each(batches)), schema)


def lists_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a matrix of hits: row and column of each, the offsets of the rows that have any, and those rows."""
    a, b = np.nonzero(mask)
    size = np.bincount(a, minlength=len(mask))
    some = np.flatnonzero(size)
    return a, b, pa.array(np.concatenate(([0], np.cumsum(size[some]))).astype(np.int32)), some
