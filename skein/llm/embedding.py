"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A rotation is three rounds of random signs and a fast Hadamard transform; its hash is the signed axis nearest to the
rotated vector. A table's key joins CODES such hashes with the label; besides the key of the nearest axes a vector
also goes to the keys in which one axis is the second nearest (multiprobe). Only keys with two vectors or more fetch
vectors. A bucket's vectors are compared by blocks of at most about BLOCK in double precision, and a pair that meets in
several buckets counts in that with the least key only, so links are counted without listing pairs; each block hands
on a star per linked set for the components. Buckets over BLOCK are dealt out as pairs of blocks.

Equal vectors of a label are one class before hashing, and are linked with one another.

Defined results: a null label, or a vector that is null, empty, zero, or holds a null or non-finite component, links
with nothing (n_links 0, component its own id, kept). Vectors of different lengths aren't linked. Rows with a null id
link with nothing either: they are returned with 0 links and a null component, kept, and count as no link of others.
Repeated rows are equal vectors. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, mix, remove, signed, trimmed, written

TABLES, CODES, BLOCK = 12, 3, 1024
KEYS = TABLES * (CODES + 1)
#: Keys for which a block holds at once who has them.
SPAN = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def keys(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The KEYS bucket keys of each unit vector (row of x); salt: a uint64 for each row that separates labels."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    signs = np.random.default_rng(width * 1_000_003).choice((-1.0, 1.0), (TABLES * CODES, 3, width))
    out, row = [], np.arange(n)
    for t in range(TABLES):
        best, second = [], []
        for c in range(CODES):
            y = x
            for s in signs[t * CODES + c]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(size, width - 2, 1)[:, -2:]
            top = np.where((size[row, top[:, 0]] > size[row, top[:, 1]])[:, None], top, top[:, ::-1])
            code = 2 * top + (y[row[:, None], top] < 0)
            best.append(code[:, 0])
            second.append(code[:, 1])
        for probe in range(-1, CODES):
            h = salt ^ np.uint64(t + 1)
            for c in range(CODES):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (second if c == probe else best)[c].astype(np.uint64) + np.uint64(1))
            out.append(h)
    return np.stack(out, 1)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, cls (null for a vector that links with nothing), v (unit, double), salt."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, unit, salts = [], [], []
            for v, label in zip(batch.column(1), batch.column(2).to_pylist()):
                x = None
                if label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False) + 0.0
                    with np.errstate(all="ignore"):
                        big = np.abs(x).max()
                        x = x / big if np.isfinite(big) and big > 0 else None
                if x is None or not np.isfinite(x).all():
                    cls.append(None), unit.append(None), salts.append(None)
                    continue
                raw = v.values.to_numpy(zero_copy_only=False) + 0.0
                salt = xxhash.xxh3_64_intdigest(f"{len(x)} {label}".encode()) >> 1
                cls.append(xxhash.xxh3_128_digest(raw.tobytes(), salt))
                unit.append(x / np.sqrt(x @ x))
                salts.append(salt)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(unit, pa.list_(pa.float64())), pa.array(salts, pa.int64())], ["id", "cls", "v", "salt"])

    cast = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("l"))
    return cast.mapInArrow(run, "id long, cls binary, v array<double>, salt long")


@trimmed
def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salt = batch.column(3).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = [None] * batch.num_rows
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            x = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
            for i, k in zip(at.tolist(), signed(keys(x, salt[at].astype(np.uint64)))):
                out[i] = np.unique(k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(out, pa.list_(pa.int64()))], ["cls", "n", "v", "keys"])


def _block(key: int, own: bool, side: np.ndarray, x: np.ndarray, n: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the members of one block pair: links counted here, and each one's first fellow of its linked set."""
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    if not own:
        link &= side[:, None] != side[None, :]
    # pairs that also meet in a bucket with a lesser key are counted there; only rows with links matter, SPAN keys at a time
    some = np.flatnonzero(link.any(1))
    if len(some):
        who = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
        flat = np.concatenate([sets[i] for i in some])
        who, flat = who[flat < key], flat[flat < key]
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        who, code = who[times[code] > 1], place[code[times[code] > 1]]
        met = np.zeros((len(some), len(some)), bool)
        for first in range(0, int(code.max()) + 1 if len(code) else 0, SPAN):
            here = (code >= first) & (code < first + SPAN)
            seen = np.zeros((len(some), SPAN), np.float32)
            seen[who[here], code[here] - first] = 1
            met |= seen @ seen.T > 0
        link[np.ix_(some, some)] &= ~met
    root = np.arange(len(x))
    if link.any():
        while True:  # least index over the links, until it stays
            new = np.minimum(root, np.where(link, root[None, :], len(x)).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
    return link @ n, root


def _compare(least: float):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each (key, i, j), which come together; a group holds about two blocks at most."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            ids = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            ends = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield held.slice(a, b - a)
            held = held.slice(int(ends[-1]) if len(ends) else 0)
        if held is not None:
            yield held

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            lists = g.column("v").chunk(0)
            x = lists.flatten().to_numpy().reshape(g.num_rows, -1)
            at = g.column("keys").chunk(0)
            sets = np.split(at.flatten().to_numpy(), np.cumsum(at.value_lengths().to_numpy())[:-1])
            key, i, j = (g.column(c)[0].as_py() for c in ("key", "i", "j"))
            count, root = _block(key, i == j, g.column("blk").to_numpy(), x, g.column("n").to_numpy(), sets, least)
            some = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
            if len(some):
                cls = g.column("cls").chunk(0)
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(some)), pa.array(count[some].astype(np.int64)), cls.take(pa.array(root[some]))], ["cls", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links, component, kept."""
    lean(vectors.sparkSession)
    rows = written(classes(vectors, id_col, vector_col, label_col), "embedding-rows")
    cls = rows.filter("cls is not null and id is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("v").alias("v"), F.first("salt").alias("salt"))
    keyed = written(cls.select("cls", "n", "v", "salt").mapInArrow(_with_keys, "cls binary, n long, v array<double>, keys array<long>"), "embedding-keys")
    flat = keyed.select("cls", F.explode("keys").alias("key"))
    size = flat.groupBy("key").count().filter("count > 1")
    met = flat.join(size, "key").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    met = met.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "cls")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(keyed, "cls").select("key", "i", "j", "blk", "cls", "n", "v", "keys").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(dealt.mapInArrow(_compare(cosine), "cls binary, links long, root binary"), "embedding-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "embedding-comp").withColumnRenamed("node", "cls")
    named = cls.select("cls", "n", "id").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = named.join(named.groupBy("comp").agg(F.min("id").alias("component")), "comp").join(links, "cls", "left")
    named = written(named.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "embedding-named")
    remove(vectors.sparkSession, keyed, found)
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(named, "cls", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op2_embedding(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
