"""Shared pieces of the training-data operators: tables, written intermediates, hashing of texts, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(65, 91))
#: A-Z to a-z; every other byte stays, so UTF-8 sequences are left alone.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(_SEPARATORS)] = True
_GAPS = IS_SPACE.tobytes()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of rows that go to Python at once, whatever their number: long texts come in small batches.
BATCH_BYTES = "16m"
#: Resident bytes of a worker from which it gives memory back after a task.
LARGE = 400 << 20


def lean(spark: SparkSession, most: str = BATCH_BYTES) -> SparkSession:
    """The session, with Arrow batches bounded by bytes too; a smaller bound that it has already stays."""
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < size(spark.conf.get(key)) <= size(most):
        spark.conf.set(key, most)
    return spark


def trimmed(run: Callable) -> Callable:
    """run, whose task gives the memory that it has freed back to the system when it ends, if the worker is large: workers
    live on between tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(AttributeError, OSError):
                if int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") > LARGE:
                    pa.default_memory_pool().release_unused()
                    ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of frames made by written() that no later step reads."""
    for df in frames:
        for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to, so that finished steps' shuffle files leave the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as bytes; a null is empty."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).tolist()
    data = memoryview(data if data is not None else b"")
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield b"" if nulls is not None and nulls[i] else bytes(data[at[i] : at[i + 1]])


def slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[pa.Array]:
    """Texts in order, about `size` bytes at a time; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        cut = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, cut - at)
        at = cut


def count_words(texts: pa.Array) -> np.ndarray:
    """The number of maximal runs of bytes that aren't ASCII white space in each text; a null has none."""
    out = [np.zeros(0, np.int64)]
    for part in slices(texts.fill_null("")):
        kind = np.int64 if pa.types.is_large_string(part.type) else np.int32
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, kind, len(part) + 1, part.offset * np.dtype(kind).itemsize).astype(np.int64)
        gap = np.ones(at[-1] - at[0] + 1, bool)
        if len(gap) > 1:
            gap[1:] = IS_SPACE[np.frombuffer(data, np.uint8, len(gap) - 1, at[0])]
        begins = gap[:-1] & ~gap[1:]
        firsts = at[:-1][at[:-1] < at[1:]] - at[0]
        begins[firsts] = ~gap[1:][firsts]
        out.append(np.diff(np.searchsorted(np.flatnonzero(begins), at - at[0])))
    return np.concatenate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, on a uint64 array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base of the rolling hash and of its inverse modulo 2**64, as far as a text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(text: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the text. A view of one copy."""
    return np.ndarray(len(text) + 33, "<u8", text + bytes(40), strides=(1,))


def prefixes(seen: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n bytes (8 at most) from each start on, given the text's windows."""
    return mix((seen[starts] & _MASK[n]) * _STEP + np.uint64(n))


def words(text: bytes, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes that aren't ASCII white space.

    Words are hashed eight bytes at a time, all words of one step together; the few longer than 32 bytes one by one.
    """
    gap = np.ones(len(text) + 2, np.int8)
    gap[1:-1] = np.frombuffer(text.translate(_GAPS), np.int8)
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    seen = windows(text) if seen is None else seen
    size = ends - starts
    h = mix((seen[starts] & _MASK[np.minimum(size, 8)]) * _STEP + size.astype(np.uint64))
    for at in (8, 16, 24):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        h[more] = mix(h[more] + (seen[starts[more] + at] & _MASK[np.minimum(size[more] - at, 8)]) * _STEP)
    for i in np.flatnonzero(size > 32).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return starts, ends, h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node and comp (the smallest node reachable) for every node of edges(a, b), which lead both ways.

    Alternating large-star and small-star steps, each an aggregation with map-side combine and a join, so a
    node with very many neighbours is never gathered; every step is written to the shared folder.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        old, now = now, written(small, name)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, old)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
