"""Removal of repeated byte strings by a suffix array of the collection, built column by column.

Every byte covered by a string of `length` bytes that also starts earlier (in a smaller id, or earlier in the same
document) is removed; strings are judged on the input, and never cross documents.

1. Pieces. A string of 100 bytes belongs to the least hash m of its 24-byte parts, so equal strings share m wherever they
   stand. Consecutive starts with the same m are one piece (77 starts at most), with the bytes of all its strings.
   Only pieces whose m stands in two places or more can hold a repeat; this is counted over all documents.
2. Equal pieces (m and hash of the bytes) are one: of all but the first, every string starts earlier elsewhere.
3. The distinct pieces that share an m with another are cut into blocks of 24 starts, counted from the place of m, and
   dealt out by the 77 bytes that all strings of a block hold. Equal ones again are one; those that share the bytes and
   differ beside them are the collection. A task builds the Burrows-Wheeler transform of
   its pieces column by column from the right: each round inserts one symbol of each piece, finds the places of the new
   suffixes by the rank of their symbol, and updates the transform and the common prefixes, which lie in sequential files
   that are read and written once a round. A walk through the finished transform names its rows. Runs with common prefixes of `length` or more are
   equal strings; all but the first of a run are repeats. Collections are bounded: an m with more than HOT distinct pieces
   is cut into its single strings instead, dealt out by the hash of the whole string.
4. The repeats of each document become intervals, and the text loses them.

Of the intervals about half come from step 2 (whole pieces that are equal), the rest from the transform of step 3, which
decides among pieces that overlap in part.

Defined results: null and empty texts, and those under `length` bytes, lose nothing. A null id orders first; rows with
equal id are ordered by a hash of their text, and equal rows share their fate as one document. Removal may cut a UTF-8
sequence, so kept bytes are binary. Other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, lean, mix, remove, signed, tidy, trimmed, utf8, written

LENGTH, PART, RUN = 100, 24, 24
#: Distinct pieces of one m in a collection, and bytes of a collection, at most (about).
HOT, COLLECTION = 4000, 512 << 10


def pieces(text: bytes, length: int = LENGTH, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """m, start and number of starts of each piece of a text, and the distance from its start to the place of m."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(text, np.uint8)
    up, down = POWERS(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    h = mix((sums[part:] - sums[:-part]) * down[: len(a) + 1 - part])
    # the least hash of each window, and among equals the leftmost: a string's own copies never share a piece with it
    low = np.uint64((1 << 31) - 1)
    least = h & ~low | np.arange(len(h), dtype=np.uint64)
    wide, width = length - part + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: -(wide - width)], least[wide - width :])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    at = (least[start] & low).astype(np.int64)
    return h[at], start, np.diff(start, append=n), at - start


def _all_pieces(docs: DataFrame, length: int) -> DataFrame:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, count = [], 0
            for i, text in enumerate(utf8(batch.column(2))):
                m, start, size, lead = pieces(text, length)
                if len(m):
                    view = memoryview(text)
                    ph = [xxhash.xxh3_64_intdigest(view[s : s + n]) for s, n in zip(start.tolist(), (size + length - 1).tolist())]
                    held.append((signed(m), np.array(ph, np.uint64).view(np.int64), start, lead << 8 | size, i))
                    count += len(m)
                if count > 200_000:
                    yield pack(held, doc, th)
                    held, count = [], 0
            if held:
                yield pack(held, doc, th)

    def pack(held: list[tuple], doc: list, th: list) -> pa.RecordBatch:
        m, ph, start, size = (np.concatenate([h[k] for h in held]) for k in range(4))
        times = [len(h[0]) for h in held]
        who = [pa.array([c[h[4]] for h in held], t).take(pa.array(np.repeat(np.arange(len(held)), times))) for c, t in ((doc, pa.int64()), (th, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(ph), *who, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["m", "ph", "doc", "th", "start", "size"])

    return docs.select("doc", "th", "text").mapInArrow(run, "m long, ph long, doc long, th long, start int, size int")


class Columns:
    """The transform (bwt) and common prefixes (lcp) of a growing collection, in sequential files."""

    def __init__(self, folder: str, strings: list[bytes]) -> None:
        # the two files stay open and are written over: making a file anew each round would wait for the disk
        self.files = [open(Path(folder) / name, "w+b", buffering=0) for name in ("bwt", "lcp")]
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        self.names = np.array(order, np.int32)
        self.sizes = np.array([len(strings[i]) for i in order])
        self.flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, so 0 is free for the end
        self.ends = np.cumsum(self.sizes)
        self.place = np.arange(len(order))  # of each string's latest suffix; the empty ones come first
        self.put(np.zeros(len(order), np.uint8), np.zeros(len(order), np.uint8))

    def put(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        for f, values in zip(self.files, (bwt, lcp)):
            f.seek(0)
            f.write(values)

    def get(self) -> list[np.ndarray]:
        for f in self.files:
            f.seek(0)
        return [np.fromfile(f, np.uint8) for f in self.files]

    def close(self) -> None:
        for f in self.files:
            f.close()

    def insert(self, j: int) -> None:
        """Round j: the suffixes of length j + 1 of all strings longer than j."""
        live = int(np.searchsorted(-self.sizes, -j, "left"))
        at, symbol = self.place[:live], self.flat[self.ends[:live] - 1 - j]
        bwt, lcp = self.get()
        bwt[at] = symbol
        by_symbol = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[by_symbol] = np.arange(len(bwt))
        ended = len(bwt) - np.count_nonzero(bwt)
        k = rank[at]
        new = len(self.sizes) + k - ended
        total = len(bwt) + live
        lcp_end = np.append(lcp, np.uint8(255))

        def common(near: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """1 + the least common prefix between two rows of one symbol; 0 where `near` says that there is none."""
            out = np.zeros(live, np.uint8)
            if near.any():
                ranges = np.stack((low[near] + 1, high[near] + 1), 1).ravel()
                out[near] = 1 + np.minimum(np.minimum.reduceat(lcp_end, ranges)[::2], np.uint8(253))
            return out

        before, after = by_symbol[k - 1], by_symbol[np.minimum(k + 1, len(bwt) - 1)]
        up = common((k > ended) & (bwt[before] == symbol), before, at)
        down = common((k + 1 < len(bwt)) & (bwt[after] == symbol), at, after)
        old = np.ones(total, bool)
        old[new] = False
        more_bwt, more_lcp = np.zeros(total, np.uint8), np.empty(total, np.uint8)
        more_bwt[old], more_lcp[old] = bwt, lcp
        has = down > 0
        more_lcp[new[has] + 1] = down[has]
        more_lcp[new] = up
        self.put(more_bwt, more_lcp)
        self.place[:live] = new

    def build(self) -> None:
        for j in range(int(self.sizes[0]) if len(self.sizes) else 0):
            self.insert(j)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of every row, by walking the transform backward from the ends."""
        bwt, _ = self.get()
        rank = np.empty(len(bwt), np.int64)
        rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        rank += len(self.sizes) - (len(bwt) - np.count_nonzero(bwt))
        sid, off, at = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32), np.arange(len(self.sizes))
        sid[at], off[at] = self.names, self.sizes
        for j in range(int(self.sizes[0]) if len(self.sizes) else 0):
            live = int(np.searchsorted(-self.sizes, -j, "left"))
            at = rank[at[:live]]
            sid[at], off[at] = self.names[:live], self.sizes[:live] - j - 1
        return sid, off


def repeats(strings: list[bytes], order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of every string of `length` bytes that also starts earlier; order: the strings' (rank, start)."""
    with tempfile.TemporaryDirectory() as folder:
        columns = Columns(folder, strings)
        columns.build()
        (_, lcp), (sid, off) = columns.get(), columns.suffixes()
        columns.close()
    joined = lcp >= length
    group = np.cumsum(~joined)
    size = np.bincount(group)
    rows = np.flatnonzero(size[group] > 1)
    group, sid, off = group[rows], sid[rows], off[rows].astype(np.int64)
    rank, start = order[sid, 0], order[sid, 1] + off
    at = np.lexsort((start, rank, group))
    later = np.concatenate(([False], group[at][1:] == group[at][:-1]))
    # the same place in two pieces is one string, so it isn't its own repeat
    same = np.concatenate(([False], (rank[at][1:] == rank[at][:-1]) & (start[at][1:] == start[at][:-1]) & later[1:]))
    first = ~later
    block = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    as_first = (rank[at] == rank[at][block]) & (start[at] == start[at][block])
    hit = at[later & ~as_first | same & ~as_first]
    return sid[hit], off[hit]


def _wanted(docs: DataFrame, length: int) -> DataFrame:
    """The blocks or single strings of the pieces in `want` (start, size, hot): b, doc, th, start, s."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc, th, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3)):
                for w in want.as_py():
                    a, lead, n = w["start"], w["size"] >> 8, w["size"] & 255
                    if w["hot"]:
                        cut = [(s, s + 1, text[s : s + length]) for s in range(a, a + n)]
                    else:
                        q = a + lead
                        lows = range(q - -(-lead // RUN) * RUN, a + n, RUN)
                        cut = [(max(a, k), min(a + n, k + RUN), text[k + RUN - 1 : k + length] + bytes((q - k,))) for k in lows]
                    for first, end, core in cut:
                        rows.append((xxhash.xxh3_64_intdigest(core, w["hot"]) - (1 << 63), doc, th, first, text[first : end + length - 1]))
                        size += length + 60
                if size > 4 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["b", "doc", "th", "start", "s"])

    return docs.select("doc", "th", "text", "want").mapInArrow(run, "b long, doc long, th long, start int, s binary")


def _found(strings: DataFrame, length: int) -> DataFrame:
    """doc, th and the interval (a, b) of every repeat among the strings of one b."""

    def solve(rows: list[tuple]) -> list[tuple]:
        docs = {d: i for i, d in enumerate(sorted({(r[1] is not None, r[1] or 0, r[2]) for r in rows}))}
        order = np.array([(docs[(r[1] is not None, r[1] or 0, r[2])], r[3]) for r in rows], np.int64)
        sid, off = repeats([r[4] for r in rows], order, length)
        return [(rows[i][1], rows[i][2], a, a + length) for i, a in zip(sid.tolist(), (order[sid, 1] + off).tolist())]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[bytes, tuple] = {}
        done, out = [], []
        b, size = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != b:
                    if len(group) > 1:
                        done += group.values()
                        size += sum(map(len, group))
                    b, group = row[0], {}
                    if size > COLLECTION:
                        out += solve(done)
                        done, size = [], 0
                # rows come in order, so the first of equal strings is the earliest
                if row[4] in group:
                    out.append((row[1], row[2], row[3], row[3] + len(row[4])))
                else:
                    group[row[4]] = row
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
        if len(group) > 1:
            done += group.values()
        if done:
            out += solve(done)
        if out:
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "th", "a", "b"])

    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = strings.select("b", "doc", "th", "start", "s").repartition(parts, "b").sortWithinPartitions("b", "doc", "th", "start")
    return dealt.mapInArrow(run, "doc long, th long, a int, b int")


def intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, th, cut (array of byte intervals that aren't merged) for documents (doc, th, text) that lose bytes."""
    found = _all_pieces(docs, length)
    often = written(found.groupBy("m").count().filter("count > 1").select("m"), "suffix-often")
    tidy(docs.sparkSession)
    twice = written(found.join(often, "m"), "suffix-pieces")
    del found
    tidy(docs.sparkSession)
    first = written(twice.groupBy("m", "ph").agg(F.min(F.struct("doc", "th", "start", "size")).alias("f")), "suffix-first")
    tidy(docs.sparkSession)
    later = twice.join(first, ["m", "ph"]).filter(F.struct("doc", "th", "start") != F.struct("f.doc", "f.th", "f.start"))
    later = written(later.select("doc", "th", F.col("start").alias("a"), (F.col("start") + F.col("size").bitwiseAND(255) + (length - 1)).alias("b")), "suffix-later")
    remove(docs.sparkSession, twice, often)
    tidy(docs.sparkSession)
    mixed = written(first.groupBy("m").count().filter("count > 1"), "suffix-mixed")
    want = first.join(mixed, "m").select("f.doc", "f.th", F.struct("f.start", "f.size", (F.col("count") > HOT).alias("hot")).alias("w"))
    want = written(want.groupBy("doc", "th").agg(F.collect_list("w").alias("want")).withColumnsRenamed({"doc": "doc_", "th": "th_"}), "suffix-want")
    remove(docs.sparkSession, first, mixed)
    tidy(docs.sparkSession)
    here = F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("th") == F.col("th_"))
    texts = docs.join(want, here).select("doc", "th", "text", "want")
    again = written(_found(_wanted(texts, length), length), "suffix-repeats")
    remove(docs.sparkSession, want)
    del texts, want
    tidy(docs.sparkSession)
    cut = again.unionByName(later).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("cut"))
    cut = written(cut, "suffix-cut")
    remove(docs.sparkSession, later, again)
    tidy(docs.sparkSession)
    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), spans (their starts and ends), kept (binary)."""
    lean(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    cut = intervals(named, length).withColumnsRenamed({"doc": "doc_", "th": "th_"})
    both = named.join(cut, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("th") == F.col("th_")), "left").select("doc", "text", "cut.a", "cut.b")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            first = 0
            for i, (text, a, b) in enumerate(zip(utf8(batch.column(1)), batch.column(2), batch.column(3))):
                spans, kept = [], text
                if a.is_valid:
                    low, high = a.values.to_numpy(), b.values.to_numpy()
                    at = np.argsort(low, kind="stable")
                    low, reach = low[at], np.maximum.accumulate(high[at])
                    new = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
                    spans = np.stack((low[new], np.append(reach[new[1:] - 1], reach[-1])), 1).tolist()
                    keep = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[keep[k] : keep[k + 1]] for k in range(0, len(keep), 2))
                rows.append((len(text), len(text) - len(kept), len(spans), spans, kept))
                size += len(kept)
                if size > 8 << 20:
                    yield pack(batch.column(0).slice(first, len(rows)), rows)
                    rows, size, first = [], 0, i + 1
            if rows:
                yield pack(batch.column(0).slice(first), rows)

    def pack(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return both.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
