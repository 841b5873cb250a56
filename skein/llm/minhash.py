"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set is its distinct shingles of k words. One pass hashes every shingle once; the top bits of the hash
choose one of 128 bins and a bin keeps its least hash. An empty bin takes over the value of another bin, found by a
sequence of random probes of its own (optimal densification). Bands of four bins name buckets. Documents with equal
sets are one class before anything is paired. In a bucket one class is the centre and is paired with the others
(a star); pairs are verified on the full sets. Further rounds draw other centres in buckets whose classes aren't yet
one component, until a round links nothing new or few blocks are left. Then every pair that shares a bucket and isn't of one component is
tested: in small buckets by a join from the second round on, in larger ones at the end. There the classes outside a
bucket's largest component meet all its classes in blocks of bounded size, which count intersections exactly.

Defined results: null, empty and blank texts have the empty set (n = 0) and link with nothing. A row with a null id
links with nothing: its component is null and it is kept. Repeated rows each keep their row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, lean, mix, remove, signed, tidy, trimmed, utf8, words, written

BINS, ROWS, PROBES = 128, 4, 256
#: Bytes of text from which array operations are shared; the mark of an empty set.
GROUP, EMPTY = 1 << 18, b""
#: In buckets up to this size pairs are tested by a join; larger ones go on with stars and end in blocks.
SMALL = 6
#: Weight of a block: its sets' sizes and EACH for every class.
BLOCK, EACH = 1 << 18, 256
#: Rounds of stars go on while the blocks that are left weigh more than this many times all classes in all buckets.
WORTH = 8
#: Shingles with more pairs than this in a block are counted by a matrix product, the others one by one.
HEAVY = 4096
_rng = np.random.default_rng(20240229)
_PROBE = _rng.integers(0, BINS, (BINS, PROBES))
_ODD = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(1, BINS // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _grouped(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """The first row, where each text begins, and the texts joined by newlines: short texts share array operations."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(utf8(column)):
        texts.append(text)
        size += len(text)
        if size > GROUP or i + 1 == len(column):
            yield first, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), b"\n".join(texts)
            first, texts, size = i + 1, [], 0


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, the sizes of their sets, and the sets, one after the other: sorted distinct
    hashes of the k-word shingles; fewer words: one shingle of them all."""
    for first, at, text in _grouped(column):
        starts, _, h = words(text.translate(LOWER))
        doc = np.searchsorted(at, starts, "right") - 1
        count = np.bincount(doc, minlength=len(at))
        n = max(0, len(h) - k + 1)
        s = np.full(n, k, np.uint64)
        for i in range(k if n else 0):
            s += h[i : i + n] * _ODD[i]
        whole = doc[:n] == doc[k - 1 :] if n else np.zeros(0, bool)
        s, d = mix(s[whole]), doc[:n][whole]
        begin = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            own = [np.uint64(count[i]) + (h[begin[i] : begin[i] + count[i]] * _ODD[: count[i]]).sum(dtype=np.uint64) for i in few]
            s, d = np.append(s, mix(np.array(own, np.uint64))), np.append(d, few)
        order = np.argsort(s)
        # small numbers are sorted by radix
        order = order[np.argsort(d[order].astype(np.uint16) if len(at) < 1 << 16 else d[order], kind="stable")]
        s, d = s[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        yield first, np.bincount(d[new], minlength=len(at)), s[new]


def bands(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The bucket of each band for each set (sizes n, hashes s one set after the other); of an empty set they mean nothing."""
    doc, bins = np.repeat(np.arange(len(n)), n), (s >> np.uint64(57)).astype(np.int64)
    at = np.flatnonzero(np.diff(doc * BINS + bins, prepend=-1))
    value, full = np.zeros((len(n), BINS), np.uint64), np.zeros((len(n), BINS), bool)
    value[doc[at], bins[at]] = s[at]
    full[doc[at], bins[at]] = True
    row, empty = np.nonzero(~full & (n > 0)[:, None])
    donor = np.full(len(row), -1)
    for probes in (slice(0, 16), slice(16, PROBES)):  # most find one soon
        left = np.flatnonzero(donor < 0)
        if len(left):
            tried = _PROBE[empty[left], probes]
            hit = full[row[left, None], tried]
            donor[left] = np.where(hit.any(1), tried[np.arange(len(left)), hit.argmax(1)], -1)
    donor = np.where(donor < 0, full[row].argmax(1), donor)
    value[row, empty] = value[row, donor]
    return mix((value.reshape(len(n), -1, ROWS) * _ODD[:ROWS]).sum(2, dtype=np.uint64) ^ _BAND)


def _digests(n: np.ndarray, s: np.ndarray) -> list[bytes | None]:
    """The 128-bit digest of each set, None of an empty one."""
    raw, ends = memoryview(s).cast("B"), np.cumsum(n).tolist()
    return [xxhash.xxh3_128_digest(raw[8 * (e - k) : 8 * e]) if k else None for k, e in zip(n.tolist(), ends)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """id, n (set size), cls (128-bit digest of the set, null if it is empty), bands."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, s in shingle_sets(batch.column(1), k):
                ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BINS // ROWS))
                keys = pa.ListArray.from_arrays(ends, pa.array(signed(bands(n, s)).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(_digests(n, s), pa.binary()), keys], ["id", "n", "cls", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, cls binary, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, s in shingle_sets(batch.column(0), k):
                cls = [c for c in _digests(n, s) if c]
                ends = pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(signed(s)))], ["cls", "s"])

    return docs.mapInArrow(run, "cls binary, s array<long>")


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    _, code = np.unique(np.concatenate(left + right), return_inverse=True)
    cut = sizes[0].sum()
    a, b = code[:cut], code[cut:]
    row, col = (np.repeat(np.arange(len(n)), n) for n in sizes)
    da, db = (np.bincount(x, minlength=code.max() + 1) for x in (a, b))
    out = np.zeros(len(left) * len(right), np.int64)
    heavy = da * db > HEAVY
    light = ~heavy[a] & (db[a] > 0)
    if light.any():
        col_by = col[np.argsort(b, kind="stable")]
        times = db[a[light]]
        ends = np.cumsum(times)
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(db) - db)[a[light]] - ends + times, times)
        out += np.bincount(np.repeat(row[light], times) * len(right) + col_by[at], minlength=len(out))
    out = out.reshape(len(left), len(right))
    if heavy.any():
        place = np.cumsum(heavy) - 1
        x, y = (np.zeros((len(n), heavy.sum()), np.float32) for n in sizes)
        for m, who, c in ((x, row, a), (y, col, b)):
            m[who[heavy[c]], place[c[heavy[c]]]] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _linked(percent: int):
    """The links of a block's first side with its second, as edges to one class of each linked group."""

    def run(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        first = np.flatnonzero(g.column("first").to_numpy())
        second = np.flatnonzero(~g.column("first").to_numpy())
        a = b = np.zeros(0, np.int64)
        if len(first) and len(second):
            lists = g.column("s").combine_chunks()
            sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            n = np.array([len(s) for s in sets])
            comp = np.unique(np.array(g.column("comp").to_pylist(), object), return_inverse=True)[1]
            both = _overlap([sets[i] for i in first], [sets[i] for i in second])
            link = (100 * both >= percent * (n[first][:, None] + n[second] - both)) & (comp[first][:, None] != comp[second])
            x, y = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            if len(x):
                link = link[np.ix_(x, y)]
                root = np.arange(len(x))
                while True:  # least index over the links, until it stays
                    near = np.where(link, root[:, None], len(x)).min(0)
                    new = np.minimum(root, np.where(link, near, len(x)).min(1))
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                a, b = np.concatenate((first[x], second[y])), first[x][np.concatenate((root, near))]
        cls = g.column("cls").combine_chunks()
        return pa.table({"a": cls.take(pa.array(a)), "b": cls.take(pa.array(b))})

    return run


def _open(member: DataFrame, comp: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """The classes in buckets with their components and weights; and of the buckets of more than `above` classes in several
    components the largest component, and the blocks of the classes outside it and of all."""
    now = member.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"), (F.col("n") + EACH).alias("w"))
    each = now.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("w").alias("w"))
    many = each.groupBy("key").agg(F.sum("m").alias("size"), F.count("*").alias("parts"), F.sum("w").alias("all"), F.max(F.struct("w", "comp")).alias("top")).filter((F.col("size") > above) & (F.col("parts") > 1))
    return now, many.select("key", F.col("top.comp").alias("big"), F.ceil((F.col("all") - F.col("top.w")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cols"))


def _rest(member: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, above: int) -> DataFrame:
    """Edges between the components that share a bucket of more than `above` classes."""
    now, open_ = _open(member, comp, above)
    met = now.join(open_, "key").withColumn("h", F.xxhash64("cls", F.lit(1)))
    few = met.filter("comp != big").select("key", "cls", "comp", F.expr("pmod(h, rows)").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("first"))
    every = met.select("key", "cls", "comp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.expr("pmod(h, cols)").cast("int").alias("j"), F.lit(False).alias("first"))
    dealt = few.unionByName(every).join(sets, "cls")
    return dealt.groupBy("key", "i", "j").applyInArrow(_linked(percent), "a binary, b binary").filter("a != b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, max_rounds: int = 12) -> DataFrame:
    """One row per document: id, n, cls, component (smallest id reachable over links), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets. After max_rounds star rounds
    at the latest, all pairs left are tested; the number of rounds changes the work, not the result.
    """
    spark = lean(docs.sparkSession)
    sig = written(signatures(docs, id_col, text_col, k), "minhash-sig")
    classes = sig.filter("cls is not null and id is not null").groupBy("cls").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("cls", "r.id", "r.n", "r.bands")
    member = classes.select("cls", "id", "n", F.explode("bands").alias("key"))
    shared = classes.select(F.explode("bands").alias("key")).groupBy("key").count().filter("count > 1").drop("count")
    # the same joins at every size: shuffles then grow in proportion
    member = written(member.join(shared.hint("merge"), "key"), "minhash-member")
    tidy(spark)
    wanted = member.select("id").distinct().hint("merge")
    sets = written(_sets(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi").select("text"), k), "minhash-sets")
    tidy(spark)

    weight = member.agg(F.sum(F.col("n") + EACH)).first()[0] or 0
    edges = tested = None
    used = [member, sets]
    comp = member.select(F.col("cls").alias("node"), F.col("cls").alias("comp")).distinct()
    for r in range(max_rounds):
        now = member.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        draw = F.xxhash64("cls", "key", F.lit(r)) if r else F.col("id")
        centre = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min(F.struct(draw.alias("d"), F.col("cls").alias("c"), F.col("comp").alias("cc"), F.col("n").alias("cn"))).alias("m")).filter("lo != hi").select("key", "size", "m.c", "m.cc", "m.cn")
        pair = now.join(centre, "key").filter("comp != cc").select("cls", "n", "c", "cn")
        if r:
            few = centre.filter(F.col("size") <= SMALL).select("key")
            here = now.join(few, "key", "left_semi")
            rest = here.join(here.select("key", F.col("cls").alias("c"), F.col("comp").alias("cc"), F.col("n").alias("cn")), "key").filter("comp != cc and cls < c").select("cls", "n", "c", "cn")
            pair = pair.unionByName(rest)
        pair = pair.filter(100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")).select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()
        if tested is not None:
            pair = pair.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        left = pair.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a")
        full = left.join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        verdict = written(full.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t")).select("a", "b", (100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).alias("link")).distinct(), "minhash-pairs")
        tidy(spark)
        linked = verdict.filter("link").count()
        tested = verdict if tested is None else tested.unionByName(verdict)
        used.append(verdict)
        if linked:
            edges = tested.filter("link").select("a", "b")
            comp = written(components(edges, "minhash-comp"), "minhash-comp")
            used.append(comp)
        # another round of stars costs about as much as these blocks
        if r and (not linked or BLOCK * (_open(member, comp, SMALL)[1].agg(F.sum(F.col("rows").cast("long") * F.col("cols"))).first()[0] or 0) <= WORTH * weight):
            break
    more = written(_rest(member, comp, sets, percent, SMALL if r else 1), "minhash-rest")
    tidy(spark)
    if not more.isEmpty():
        edges = more if edges is None else edges.unionByName(more)
        comp = written(components(edges, "minhash-comp"), "minhash-comp")
        used.append(comp)
    named = classes.select("cls", "id").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("id").alias("component"))
    named = written(named.join(least, "comp").select("cls", "component"), "minhash-named")
    remove(spark, more, *used)
    return sig.select("id", "n", "cls").join(named, "cls", "left").select("id", "n", "cls", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that another of their component stands for; all columns stay.

    Rows of one id are judged by their own texts; rows with a null id stay.
    """
    gone = written(near_duplicates(docs, id_col, text_col, k, percent).filter(~F.col("kept")).select("id", "cls").distinct(), "minhash-gone")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [c or EMPTY for _, n, s in shingle_sets(batch.column(1), k) for c in _digests(n, s)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), batch.column(2)], ["id", "cls", "th"])

    own, th = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows = docs.select(own.alias("id"), F.col(text_col).alias("text"), th.alias("th")).join(gone.select("id"), "id", "left_semi")
    out = rows.mapInArrow(run, "id long, cls binary, th long").join(gone, ["id", "cls"]).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(out, (own == F.col("__id")) & (th == F.col("__th")), "left_anti")


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, k=4)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")
