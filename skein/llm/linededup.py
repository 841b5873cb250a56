"""Line de-duplication by an exact set-similarity join.

A line is what stands between newlines; its set is its distinct words, A-Z lower-cased. A line is removed if an earlier
line (smaller id, or an earlier line of the same document) has a set with 100 * |intersection| >= percent * |union|;
lines are judged on the input, not on what is left. Lines without words stay.

1. Order: words are ordered by the rank of their bucket of 2**19, the one that occurs least in all documents first, then by
   hash. The table of buckets has one size whatever the corpus; words that share a bucket only come later than they could.
2. Lines whose sets have the same 128-bit digest are one class; all but the first line of a class go at once. Tasks keep
   the first line of a class before they hand classes on, so a line that is everywhere is sent once per task and part.
3. A class goes to the tokens of its prefix, the |x| - ceil(percent * |x| / 100) + 1 rarest. Classes that meet at a token
   are compared there by length, position and a 126-bit parity map of their words (its differing bits are no more than
   the words that differ), all of them exact bounds. Each class hands on up to FEW possible partners of
   a token, those first that the maps tell least apart; classes that have more and no match among those look again.
4. Tokens with very many classes are dealt out as pairs of blocks. Of these, the HOTS with the most classes are told to
   the tasks: a table of bounded size, beyond which a token has less than 1 / HOTS of all entries.
5. Candidate pairs are verified on the words of the lines themselves, which are read from the documents again.
6. Classes that look again come to their tokens by name, so that no other class does so. Their lines and those of possible
   partners are compared where they meet: each line comes once for a token (and pair of blocks), no pair is made.

Between the steps arrays travel in binary blobs, one for each task and target, so that shuffles handle few rows. What
tells tasks which lines and tokens are wanted are bitmaps of at most 2**26 places, filled by hashes: a false hit costs
time, never a result, since joins and verification follow.

Defined results: null and empty texts have no lines to remove. A null id orders first, as the least long. Rows with equal
id are ordered by a hash of their text; equal rows share their lines' fate as one document. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, lean, mix, remove, signed, tidy, trimmed, utf8, words, written

#: Buckets of words, and the parts in which tables are added up.
_BITS = 19
BUCKETS, CHUNKS = 1 << _BITS, 64
#: Classes in a token's block, the part of the classes that tells which tokens are larger, and the most of these tokens.
BLOCK, SAMPLE, HOTS = 20_000, 64, 1 << 20
#: Passes over the tokens.
PASSES = 2
#: Possible partners of a class that a token hands on before any is verified.
FEW = 2
#: Wanted lines up to which their documents' ids are broadcast.
FEW_DOCS = 100_000
#: Bytes of text from which array operations are shared, and after which blobs are dealt out; bytes of blobs in a batch.
GROUP, FLUSH, SENT = 1 << 18, 8 << 20, 2 << 20
#: Classes in a blob, candidate pairs that a task holds, and the places of a bitmap (a power of two each way).
CHUNK, HELD, PLACES = 1 << 14, 1 << 20, (16, 26)
_SPAN = 1 << 16
_NONE = -(1 << 63)
_MOST = np.uint64((1 << 64) - 1)
#: Columns of 8 bytes in the blobs of lines, of places, of classes, of classes at their tokens, and of those that look for partners.
_LINE = ("hi", "lo", "doc", "th", "line", "n", "k", "m0", "m1")
_PLACE = ("doc", "th", "line")
_CLASS = ("id", "doc", "n", "k", "m0", "m1")
_AT = ("token", "ij", "id", "doc", "n", "size", "m0", "m1")
_ASK = ("token", "ij", "id")

Arrays = dict[str, np.ndarray]


def _pack(g: Arrays, names: tuple[str, ...]) -> bytes:
    return b"".join(g[c].astype(np.int64, copy=False).tobytes() if g[c].dtype != np.uint64 else g[c].tobytes() for c in names)


def _unpack(blob, names: tuple[str, ...]) -> Arrays:
    return dict(zip(names, np.frombuffer(blob, np.int64).reshape(len(names), -1)))


def _join(parts: list[Arrays]) -> Arrays:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else {}


def _some(g: Arrays, at: np.ndarray) -> Arrays:
    """The rows `at` of lines or classes, whose prefixes lie one after the other in g["pre"]."""
    k = g["k"][at]
    starts = (np.cumsum(g["k"]) - g["k"])[at]
    out = {c: v[at] for c, v in g.items() if c != "pre"}
    out["pre"] = g["pre"][np.repeat(starts - np.cumsum(k) + k, k) + np.arange(k.sum())]
    return out


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _batch(schema: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema)


def _sent(schema: list[str], kinds: tuple[pa.DataType, ...], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows with blobs, in batches of SENT bytes and one row more at most, so that neither side holds all of them at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SENT:
            yield _batch(schema, *map(pa.array, zip(*held), kinds))
            held, size = [], 0
    if held:
        yield _batch(schema, *map(pa.array, zip(*held), kinds))


def _groups(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, bytes]]:
    """Rows, the number of each one's first line, and their texts joined by newlines: short texts share array operations."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(utf8(column)):
        rows.append(i)
        texts.append(text)
        size += len(text)
        if size > GROUP or i + 1 == len(column):
            yield rows, np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)]), b"\n".join(texts)
            rows, texts, size = [], [], 0


def _sorted(code: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """code with each line's part in rising order; the lines begin at `first` and have n words. Lines of about one length are
    sorted together, as the rows of a matrix."""
    out, width = np.empty_like(code), np.ceil(np.log2(n)).astype(np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        column = np.arange(1 << w)
        there = column < n[rows, None]
        at = (first[rows, None] + column)[there]
        m = np.full(there.shape, _MOST)  # what fills a row up stays behind its words
        m[there] = code[at]
        m.sort(axis=1)
        out[at] = m[there]
    return out


def _tokens(text: bytes, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lines that have words, where each one's words begin, and all lines' distinct words in the order of
    rarity, as 64-bit codes that sort that way: one code for each hash."""
    text = text.translate(LOWER)
    starts, _, h = words(text)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    code = rank[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - _BITS) | h >> np.uint64(_BITS)
    ends = np.searchsorted(starts, np.flatnonzero(np.frombuffer(text, np.uint8) == 10))
    n = np.diff(ends, prepend=0, append=len(starts))
    line = np.flatnonzero(n)
    n = n[line]
    first = np.cumsum(n) - n
    code = _sorted(code, first, n)
    new = _new(code)
    new[first] = True
    n = np.add.reduceat(new, first, dtype=np.int64)
    return line, np.cumsum(n) - n, code[new]


def _table(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, kind: type, add: Callable = np.add) -> np.ndarray:
    """An array that every task fills for its rows; the tasks' arrays are added up (or combined by `add`) chunk by chunk."""

    @trimmed
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            fill(total, batch)
        yield from rows(dict(enumerate(total.reshape(CHUNKS, -1))))

    @trimmed
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                here = np.frombuffer(n.as_buffer(), kind)
                total[chunk] = add(total[chunk], here) if chunk in total else here
        yield from rows(total)

    def rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = {k: v for k, v in total.items() if v.any()}
        yield _batch(["chunk", "n"], pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary()))

    out, schema = np.zeros((CHUNKS, size // CHUNKS), kind), "chunk int, n binary"
    for r in df.mapInArrow(each, schema).repartition(8, "chunk").mapInArrow(combine, schema).collect():  # CHUNKS rows at most
        out[r["chunk"]] = np.frombuffer(r["n"], kind)
    return out.ravel()


def _rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each bucket by its count."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, text in _groups(batch.column(0)):
            np.add.at(total, (words(text.translate(LOWER))[2] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)

    return _ranked(_table(docs, fill, BUCKETS, np.int64))


def _ranked(count: np.ndarray) -> np.ndarray:
    rank = np.empty(len(count), np.uint32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
    return rank


def _hash(*keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64) + np.uint64(1))
    return h


def _bitmap(df: DataFrame, n: int) -> np.ndarray:
    """A bitmap (packed) of the hashes of df's n rows of longs, about eight places a row."""
    bits = min(max(PLACES[0], (8 * n).bit_length()), PLACES[1])

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        at = _hash(*(c.to_numpy() for c in batch.columns)) >> np.uint64(64 - bits)
        np.bitwise_or.at(total, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    return _table(df.coalesce(CHUNKS), fill, 1 << bits - 3, np.uint8, np.bitwise_or)


def _hit(bitmap: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    at = _hash(*keys) >> np.uint64(64 - 3 - len(bitmap).bit_length() + 1)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _firsts(g: Arrays) -> tuple[Arrays, Arrays]:
    """The first line of each class, by class, and the places of all other lines."""
    order = np.lexsort([g[c] for c in ("line", "th", "doc", "lo", "hi")])
    cls, place = (_new(*(g[c][order] for c in names)) for names in (("hi", "lo"), ("hi", "lo", "doc", "th", "line")))
    first = np.flatnonzero(cls)
    # lines at the place of the first are the same line of an equal row
    own = np.repeat(order[first], np.diff(first, append=len(order)))
    later = place & ~cls & ((g["doc"][order] != g["doc"][own]) | (g["th"][order] != g["th"][own]) | (g["line"][order] != g["line"][own]))
    return _some(g, order[first]), {c: g[c][order[later]] for c in _PLACE}


def _lines(docs: DataFrame, rarity: np.ndarray, percent: int, parts: int) -> DataFrame:
    """Blobs of lines by part: kind 0, the first ones of classes; kind 1, the places of lines that have an earlier equal."""
    shipped = docs.sparkSession.sparkContext.broadcast(rarity)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, held, size = shipped.value, [], 0
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, starts, text in _groups(batch.column(2)):
                line, first, code = _tokens(text, rarity)
                if len(line):
                    at = np.searchsorted(starts, line, "right") - 1
                    who = np.array(rows)[at]
                    held.append({"doc": doc[who], "th": th[who], "line": line - starts[at]} | describe(first, code))
                size += len(text)
                if size > FLUSH:
                    yield from deal(held)
                    held, size = [], 0
        yield from deal(held)

    def describe(first: np.ndarray, code: np.ndarray) -> Arrays:
        n = np.diff(first, append=len(code))
        bit = mix(code) % np.uint64(126)
        one = np.uint64(1) << bit % np.uint64(63)
        m0, m1 = (np.bitwise_xor.reduceat(np.where(side, one, np.uint64(0)), first) for side in (bit < 63, bit >= 63))
        raw = memoryview(code).cast("B")
        cls = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + k)]) for a, k in zip(first.tolist(), n.tolist())), np.int64)
        k = n + (-percent * n // 100) + 1
        head = np.arange(len(code)) - np.repeat(first, n) < np.repeat(k, n)
        return {"hi": cls[::2], "lo": cls[1::2], "n": n, "k": k, "m0": signed(m0), "m1": signed(m1), "pre": signed(code[head])}

    def deal(held: list[Arrays]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        g = _join(held)
        held.clear()
        first, later = _firsts(g)
        del g
        part = (_hash(first["hi"]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, part = _some(first, order), part[order]
        cuts = np.append(np.flatnonzero(_new(part)), len(part))
        ends = np.concatenate(([0], np.cumsum(first["k"])))

        def blobs() -> Iterator[tuple[int, int, bytes, bytes]]:
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield int(part[a]), 0, _pack({c: first[c][a:b] for c in _LINE}, _LINE), first["pre"][ends[a] : ends[b]].tobytes()
            if len(later["doc"]):
                yield int(_hash(later["th"][:1])[0] % np.uint64(parts)), 1, _pack(later, _PLACE), b""

        yield from _sent(["p", "kind", "rec", "pre"], (pa.int32(), pa.int32(), pa.binary(), pa.binary()), blobs())

    return docs.select("doc", "th", "text").mapInArrow(run, "p int, kind int, rec binary, pre binary")


@trimmed
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's blobs: kind 0, each class's number and the place of its first line; kind 1, the places of all other
    lines; kind 2, blobs of classes; kind 3, the tokens of one class in SAMPLE, as numbers."""
    schema = ["kind", "id", "doc", "th", "line", "rec", "pre"]

    def places(kind: int, ids: np.ndarray | None, g: Arrays) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(g["doc"]), _SPAN):
            n = len(g["doc"][a : a + _SPAN])
            none = pa.nulls(n, pa.binary())
            yield _batch(schema, pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()) if ids is None else ids[a : a + _SPAN], *(g[c][a : a + _SPAN] for c in _PLACE), none, none)

    held, size, base = [], 0, 0
    for batch in batches:
        for kind, rec, pre in zip(*batch.columns[1:]):
            if kind.as_py():
                yield from places(1, None, _unpack(rec.as_buffer(), _PLACE))
                continue
            held.append(_unpack(rec.as_buffer(), _LINE) | {"pre": np.frombuffer(pre.as_buffer(), np.int64)})
            size += len(held[-1]["n"])
            if size > 2 * base + HELD // 4:  # what is held stays in proportion to the part's classes
                first, later = _firsts(_join(held))
                yield from places(1, None, later)
                held, size = [first], len(first["n"])
                base = size
    if not held:
        return
    first, later = _firsts(_join(held))
    yield from places(1, None, later)
    first["id"] = (TaskContext.get().partitionId() << 40) + np.arange(len(first["n"]))
    yield from places(0, first["id"], first)
    for a in range(0, len(first["n"]), CHUNK):
        g = _some(first, np.arange(a, min(a + CHUNK, len(first["n"]))))
        token = g["pre"][np.repeat(_hash(g["id"]) % np.uint64(SAMPLE) == 0, g["k"])]
        if len(token):
            none, blob = pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary())
            yield _batch(schema, pa.array(np.full(len(token), 3, np.int32)), token, none, none, none, blob, blob)
        none = pa.nulls(1, pa.int64())
        yield _batch(schema, pa.array([2], pa.int32()), none, none, none, none, pa.array([_pack(g, _CLASS)], pa.binary()), pa.array([g["pre"].tobytes()], pa.binary()))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Arrays, np.ndarray, np.ndarray]]:
    """Blobs of classes, and of each of their prefixes' tokens the class's row and the position."""
    for batch in batches:
        for rec, pre in zip(*batch.columns):
            g = _unpack(rec.as_buffer(), _CLASS) | {"pre": np.frombuffer(pre.as_buffer(), np.int64)}
            row = np.repeat(np.arange(len(g["n"])), g["k"])
            yield g, row, np.arange(len(row)) - np.repeat(np.cumsum(g["k"]) - g["k"], g["k"])


def _hot(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) of more than BLOCK classes, by those (token) of a sample of the classes, and their numbers of blocks."""
    many = sample.groupBy("token").count().filter(F.col("count") * SAMPLE > BLOCK)
    found = many.orderBy(F.desc("count"), "token").limit(HOTS).toArrow()
    token, count = (found.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    return token[order], -(-count[order] * SAMPLE // BLOCK)


def _dealt(blobs: DataFrame, hot: tuple[np.ndarray, np.ndarray], part: int, passes: int, parts: int, again: tuple[np.ndarray, DataFrame] | None) -> DataFrame:
    """Blobs of the classes at their tokens (kind 0), of which `part` takes one in `passes`; again: a bitmap of the tokens that
    are looked at, and the numbers (id) and tokens of the classes that look for partners, which come as blobs too (kind 1)."""
    shipped = blobs.sparkSession.sparkContext.broadcast((hot, None if again is None else again[0]))
    schema = "p int, kind int, rec binary"

    def mine(token: np.ndarray) -> np.ndarray:
        return _hash(token) % np.uint64(passes) == part

    def spread(id: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of classes at tokens, once for each block of the token; whose blocks meet, and whether the own one is the second."""
        tokens, blocks = shipped.value[0]
        times = np.ones(len(token), np.int64)
        if len(tokens):
            found = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
            times = np.where(tokens[found] == token, blocks[found], 1)
        row = np.repeat(np.arange(len(token)), times)
        own = (_hash(id, token) % times.astype(np.uint64)).astype(np.int64)[row]
        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        return row, np.minimum(own, other) << 32 | np.maximum(own, other), own > other

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value[1]
        held, size = [], 0
        for g, row, pos in _entries(batches):
            some = mine(g["pre"])
            if wanted is not None:
                some &= _hit(wanted, g["pre"])
            token, row, pos = g["pre"][some], row[some], pos[some]
            at, ij, second = spread(g["id"][row], token)
            out = {c: g[c][row[at]] for c in ("id", "doc", "n", "m0", "m1")}
            held.append(out | {"token": token[at], "ij": ij, "size": pos[at] << 1 | second.astype(np.int64)})
            size += len(at)
            if size > HELD // 4:
                yield from deal(held)
                held, size = [], 0
        yield from deal(held)

    @trimmed
    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id, token = (c.to_numpy() for c in batch.columns)
            some = mine(token)
            id, token = id[some], token[some]
            at, ij, _ = spread(id, token)
            yield from deal([{"token": token[at], "ij": ij, "id": id[at]}], 1, _ASK)

    def deal(held: list[Arrays], kind: int = 0, names: tuple[str, ...] = _AT) -> Iterator[pa.RecordBatch]:
        g = _join(held)
        held.clear()
        if g and len(g["token"]):
            to = (_hash(g["token"], g["ij"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if parts < 1 << 16 else to, kind="stable")
            to = to[order]
            cuts = np.append(np.flatnonzero(_new(to)), len(to))
            blobs = ((int(to[a]), kind, _pack({c: g[c][order[a:b]] for c in names}, names)) for a, b in zip(cuts[:-1], cuts[1:]))
            yield from _sent(["p", "kind", "rec"], (pa.int32(), pa.int32(), pa.binary()), blobs)

    out = blobs.mapInArrow(run, schema)
    if again is not None:
        out = out.unionByName(again[1].select("id", "token").mapInArrow(asking, schema))
    return out.repartitionById(parts, "p")


def _asked(g: Arrays, asks: Arrays) -> np.ndarray:
    """Which classes at tokens are among those that look for partners."""
    keys = [np.concatenate((g[c], asks[c])) for c in _ASK]
    order = np.lexsort(keys)
    group = np.cumsum(_new(*(k[order] for k in keys))) - 1
    out = np.zeros(len(order), bool)
    out[order] = np.bincount(group, order >= len(g["id"]))[group] > 0
    return out[: len(g["id"])]


def _partners(percent: int, every: bool):
    """Of a part's blobs of classes at tokens: possible partners of each class, and the maps' differing bits; a pair of a class
    with itself says that it has more partners, and has the token in place of bits. If `every`: the classes at tokens that
    look for partners and have any, and all those partners, no pairs."""

    def passing(g: Arrays, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that no bound rules out, the later class first, and the maps' differing bits."""
        nx, ny = g["n"][xs], g["n"][ys]
        differ = np.bitwise_count(g["m0"][xs] ^ g["m0"][ys]).astype(np.int32) + np.bitwise_count(g["m1"][xs] ^ g["m1"][ys])
        both = nx + ny
        ok = differ * (100 + percent) <= both * (100 - percent)
        xs, ys, nx, ny, both, differ = xs[ok], ys[ok], nx[ok], ny[ok], both[ok], differ[ok]
        need = -(-percent * both // (100 + percent))
        ok = (np.minimum(nx - g["pos"][xs], ny - g["pos"][ys]) >= need)
        ok &= g["own"][xs] | (g["side"][xs] != g["side"][ys])
        xs, ys, differ = xs[ok], ys[ok], differ[ok]
        x, y = (g["doc"][k] for k in (xs, ys))
        swap, same = x < y, x == y
        xs, ys = np.where(swap, ys, xs), np.where(swap, xs, ys)
        # of one id: which is later is seen when the pair is verified
        xs, ys, differ = np.concatenate((xs, ys[same])), np.concatenate((ys, xs[same])), np.concatenate((differ, differ[same]))
        ok = g["open"][xs]
        return xs[ok], ys[ok], differ[ok]

    def best(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs found, FEW + 1 of each first row at most, and how many of it come before each."""
        xs, ys, differ = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((ys, differ, xs))
        xs, ys, differ = xs[order], ys[order], differ[order]
        nth = np.arange(len(xs)) - np.maximum.accumulate(np.where(_new(xs), np.arange(len(xs)), 0))
        few = nth <= FEW
        return xs[few], ys[few], differ[few], nth[few]

    def compare(g: Arrays, group: np.ndarray) -> Iterator[tuple]:
        """Pairs within groups of equal number, whose rows come by size."""
        rows = np.arange(len(group))
        first = np.maximum.accumulate(np.where(_new(group), rows, 0))
        found, size, step, at, n, met = [], 0, 1, rows[rows > first], g["n"], np.zeros(len(rows), bool)
        while len(at):  # all rows against the row `step` before them, as long as that is in their group and not too short
            at = at[n[at - step] * 100 >= percent * n[at]]
            look = at[g["open"][at] | g["open"][at - step]] if every else at
            for a in range(0, len(look), _SPAN):
                xs, ys, differ = passing(g, look[a : a + _SPAN], look[a : a + _SPAN] - step)
                if every:
                    met[xs] = met[ys] = True
                elif len(xs):
                    found.append((xs, ys, differ))
                    size += len(xs)
                    if size > HELD + 4 * len(rows):
                        found = [best(found)[:3]]
                        size = len(found[0][0])
            step += 1
            at = at[at - step >= first[at]]
        if found:
            xs, ys, differ, nth = best(found)
            few, more = nth < FEW, xs[nth == FEW]
            yield g["id"][xs[few]], g["id"][ys[few]], differ[few].astype(np.int64)
            yield g["id"][more], g["id"][more], g["token"][more]
        if every:
            yield tuple(g[c][met] for c in (*_ASK, "open"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[Arrays], list[Arrays]] = ([], [])
        for batch in batches:
            for kind, rec in zip(batch.column(1).to_pylist(), batch.column(2)):
                held[kind].append(_unpack(rec.as_buffer(), _ASK if kind else _AT))
        g, asks = map(_join, held)
        if not g or every and not asks:
            return
        g["open"] = _asked(g, asks) if every else np.ones(len(g["id"]), bool)
        order = np.lexsort((g["id"], g["n"], g["ij"], g["token"]))
        group = np.cumsum(_new(g["token"][order], g["ij"][order]))
        met = ((np.bincount(group) > 1) & (np.bincount(group, g["open"][order]) > 0))[group]
        order, group = order[met], group[met]
        g = {c: v[order] for c, v in g.items()}
        ij, size = g["ij"], g.pop("size")
        g |= {"own": ij >> 32 == ij & 0xFFFFFFFF, "side": size & 1, "pos": size >> 1}
        for columns in compare(g, group):
            if len(columns[0]):
                yield _batch([*_ASK, "asks"] if every else ["a", "b", "d"], *columns)

    return run


def _met(percent: int):
    """Of lines that meet at tokens, sorted by token and blocks, those that look for partners first: the numbers and places of
    the latter whose words match an earlier line's. Only they are held, as numbers of words; the others pass by."""

    def matching(group: Iterator[tuple]) -> np.ndarray:
        """Number and place of each line of one token and pair of blocks that looks for partners and matches."""
        number: dict[bytes, int] = {}
        own, sets, other = [], [], []
        for _, _, asks, *place, text in group:
            if not asks:
                other = [(place, text)]
                break
            own.append(place)
            sets.append(np.array([number.setdefault(w, len(number)) for w in {*text.split()}], np.int64))
        gone, there = np.zeros(len(own), bool), np.zeros(len(number), bool)
        if own:
            n = np.array([len(x) for x in sets])
            flat, first, rows = np.concatenate(sets), np.cumsum(n) - n, np.array(own)
            passing = ((place, {*text.split()}) for place, text in chain(other, ((row[3:7], row[7]) for row in group)))
            among = ((place, np.array([number[w] for w in x if w in number], np.int64), len(x)) for place, x in passing)
            for (_, doc, th, line), x, m in chain(zip(own, sets, n), among):
                there[x] = True
                both = np.add.reduceat(there[flat], first, dtype=np.int64)
                there[x] = False
                _, d, t, i = rows.T
                later = (d > doc) | (d == doc) & ((t > th) | (t == th) & (i > line))
                gone |= later & (100 * both >= percent * (n + m - both))
        return np.array(own, np.int64).reshape(-1, 4)[gone]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, itemgetter(0, 1)):
            out = matching(group)
            if len(out):
                yield _batch(["id", *_PLACE], *out.T)

    return run


def _texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Places and lower-cased texts of lines, all the n wanted ones (doc, th, line) among them."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(*_PLACE), n))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, starts, text in _groups(batch.column(2)):
                ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
                at = np.repeat(np.array(rows), np.diff(starts))
                line = np.arange(len(ends)) - np.repeat(starts[:-1], np.diff(starts))
                some = np.flatnonzero(_hit(bitmap, doc[at], th[at], line))
                if len(some):
                    begins = np.concatenate(([0], ends[:-1] + 1))
                    texts = [text[a:b].translate(LOWER) for a, b in zip(begins[some].tolist(), ends[some].tolist())]
                    yield _batch([*_PLACE, "words"], doc[at[some]], th[at[some]], line[some], pa.array(texts, pa.binary()))

    return docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, line long, words binary")


def _verified(percent: int):
    """Those classes (the later ones of pairs), and the places of their first lines, whose lines' words do match."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                wa, wb = (part.column(c).to_pylist() for c in ("wa", "wb"))
                sets = {text: frozenset(text.split()) for text in {*wa, *wb}}  # at the bytes that part words
                out = []
                for i, (x, y) in enumerate(zip(map(sets.__getitem__, wa), map(sets.__getitem__, wb))):
                    both = len(x & y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append(i)
                yield part.select(["id", *_PLACE]).take(pa.array(out, pa.int64()))

    return run


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc, th (hash of the text) and gone, an array of the line numbers to remove, for documents that lose any.

    docs: columns doc (no nulls), th and text.
    """
    spark = lean(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rarity = _rarity(docs.select("text"))
    schema = "kind int, id long, doc long, th long, line long, rec binary, pre binary"
    base = written(_lines(docs, rarity, percent, parts).repartitionById(parts, "p").mapInArrow(_classes, schema), "lines")
    tidy(spark)
    first, later, blobs, sample = (base.filter(F.col("kind") == k) for k in range(4))
    first, blobs = first.select("id", *_PLACE), blobs.select("rec", "pre")
    hot, used = _hot(sample.select(F.col("id").alias("token"))), [base]

    def search(again: tuple[np.ndarray, DataFrame] | None = None) -> DataFrame:
        out = None
        # a pass for each part of the tokens bounds what the shuffle has on disk at once; a bitmap lets few tokens through
        passes = PASSES if again is None or len(again[0]) == 1 << PLACES[1] - 3 else 1
        for k in range(passes):
            dealt = _dealt(blobs, hot, k, passes, 2 * parts if again is None else parts, again)
            if again is None:
                # each pair once: fewer rows, and few files to read again
                part = dealt.mapInArrow(_partners(percent, False), "a long, b long, d long")
                part = written(part.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("d")).alias("token")).distinct(), "lines-pairs")
            else:
                part = written(dealt.mapInArrow(_partners(percent, True), "token long, ij long, id long, asks boolean"), "lines-met")
            tidy(spark)
            out = part if out is None else out.unionByName(part)
            used.append(part)
        return out

    def read(ids: DataFrame) -> DataFrame:
        """Numbers, words and places (f) of classes' first lines."""
        wanted = written(first.join(ids, "id"), "lines-wanted")
        n = wanted.count()
        # few lines: only their documents leave the scan
        some = docs.join(F.broadcast(wanted.select("doc").distinct()), "doc", "left_semi") if n <= FEW_DOCS else docs
        # equal rows give the same line again
        texts = _texts(some, wanted, n).join(wanted, list(_PLACE)).groupBy("id").agg(F.first("words").alias("words"), F.first(F.struct(*_PLACE)).alias("f"))
        texts = written(texts, "lines-texts")
        remove(spark, wanted)
        return texts

    def verified(rows: DataFrame, run: Callable, *kept: DataFrame) -> DataFrame:
        """Numbers and places of the classes that match an earlier one; the frames kept go."""
        out = written(rows.mapInArrow(run, "id long, doc long, th long, line long").distinct(), "lines-matched")
        remove(spark, *kept)
        tidy(spark)
        used.append(out)
        return out

    def of_pairs(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b").distinct(), "lines-distinct")
        texts = read(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sides = [texts.select(F.col("id").alias(c), F.col("words").alias(f"w{c}"), F.col("f").alias(f"f{c}")) for c in "ab"]
        later = F.when(F.col("fa") > F.col("fb"), F.struct(F.col("a").alias("id"), "fa.*")).otherwise(F.struct(F.col("b").alias("id"), "fb.*"))
        full = pairs.join(sides[0], "a").join(sides[1], "b").select(later.alias("l"), "wa", "wb").select("l.*", "wa", "wb")
        return verified(full, _verified(percent), pairs, texts)

    def of_meetings(met: DataFrame) -> DataFrame:
        texts = read(met.select("id").distinct())
        full = met.join(texts, "id").select("token", "ij", "asks", "id", "f.*", "words")
        return verified(full.repartition("token", "ij").sortWithinPartitions("token", "ij", F.desc("asks")), _met(percent), texts)

    found = search()
    matched = of_pairs(found.filter("a != b"))
    again = written(found.filter("a = b").select(F.col("a").alias("id"), "token").distinct().join(matched, "id", "left_anti"), "lines-again")
    if n := again.count():
        matched = matched.unionByName(of_meetings(search((_bitmap(again.select("token"), n), again))))
    gone = later.select(*_PLACE).unionByName(matched.select(*_PLACE))
    gone = written(gone.groupBy("doc", "th").agg(F.collect_set(F.col("line").cast("int")).alias("gone")), "lines-gone")
    remove(spark, again, *used)
    return gone


@F.arrow_udf(StructType().add("text", "string").add("n_lines", "long"))
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without their lines of these numbers, in time linear in both, and how many lines they had."""
    out, n = [], []
    for t, g in zip(utf8(text), gone):
        lines = t.split(b"\n")
        if g.is_valid:
            lost = set(g.values.to_pylist())
            t = b"\n".join(x for i, x in enumerate(lines) if i not in lost)
        out.append(t)
        n.append(len(lines))
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()).view(pa.string()), pa.array(n, pa.int64())], ["text", "n_lines"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with the text shortened by its removed lines (and their newlines), n_lines and n_removed."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    named = docs.select(F.struct("*").alias("__row"), key.alias("__doc"), F.xxhash64(text_col).alias("__th"), F.col(text_col).alias("__text"))
    gone = removed_lines(named.select(F.col("__doc").alias("doc"), F.col("__th").alias("th"), F.col("__text").alias("text")), percent)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed") or c in (id_col, text_col)]
    text, lost = F.col("__row")[text_col], F.col("gone")
    # the lists of lines are hashed, a part at a time, so that texts aren't sorted
    out = named.drop("__text").join(gone.hint("shuffle_hash"), (F.col("__doc") == F.col("doc")) & (F.col("__th") == F.col("th")), "left")
    # only texts that lose lines go to Python
    cut = _without(F.when(lost.isNotNull(), text), lost)
    shorter = F.when(lost.isNull(), text).otherwise(cut["text"])
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    n_lines = F.when(lost.isNotNull(), cut["n_lines"]).when(F.coalesce(F.octet_length(text), F.lit(0)) > 0, breaks + 1).otherwise(0).cast("long")
    made = [x for x in (n_lines.alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_removed"))]
    return out.select(*[shorter.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in own], *made)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
