"""Media columns: bytes in a declared type, sniffed by signature.

An Aho-Corasick automaton finds the magic bytes of all known formats, and the end marks of those that need them, in one
pass. A validator for each format then checks its structure and gives its length; a hit that fails is nothing. A hit at
byte 0 that covers the value corrects the declared type; valid hits elsewhere are embedded media, which carve() returns
with their offsets. What lies inside an embedded medium is part of it; a value that is one whole medium is looked into.

Lengths: PNG by its chunks and their checksums; JPEG by its segments and scans; GIF by its blocks; BMP and RIFF by
their sizes; PDF up to the last %%EOF before the next header whose startxref points at a cross-reference; ZIP by the end
record whose directory leads back to the archive's start; GZIP by decompression, checksum and size; Ogg by pages whose checksums fit, from
one that begins a stream; FLAC by frames whose header and body checksums fit, up to the sample count of its header.

Stored form of a text: a WAV file of unsigned 8-bit samples, one channel; its data chunk is the payload.

Defined results: a null value has no media (type null, nothing carved); null and empty texts have a payload of 64
zeros; equal values give equal results. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, trimmed, utf8


RATE = 8000
#: The formats' magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
}
#: The marks that end a PDF and a ZIP archive.
ENDS = (b"%%EOF", b"PK\x05\x06")
_FLUSH = 8 << 20


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for m in (*MAGIC, *ENDS):
        a.add_word(m.decode("latin-1"), m)
    a.make_automaton()
    return a


class _Value:
    """A value, and where marks stand in it. Validators take it and an offset and give the medium's length there, or 0."""

    def __init__(self, value: bytes) -> None:
        self.bytes, self.view, self.n = value, memoryview(value), len(value)
        self.at: dict[bytes, list[int]] = {}
        for end, mark in automaton().iter(value.decode("latin-1")):
            self.at.setdefault(mark, []).append(end - len(mark) + 1)
        # places that no walk over a format's parts gets beyond
        self.dead: set[tuple[str, int]] = set()
        self._zero = (0, -2)

    def zero(self, p: int) -> int:
        """The first zero byte from p on, or -1; the last answer serves as long as it holds."""
        asked, found = self._zero
        if not (asked <= p and (p <= found or found == -1)):
            found = self.bytes.find(b"\0", p)
            self._zero = (p, found)
        return found

    @cached_property
    def archives(self) -> dict[int, int]:
        """Where ZIP archives begin and end, by their end records; of several for one start the last."""
        out = {}
        for e in self.at.get(ENDS[1], ()):
            if e + 22 <= self.n:
                size, start, note = struct.unpack_from("<IIH", self.bytes, e + 12)
                begin = e - size - start
                if begin >= 0 and e + 22 + note <= self.n and (not size or self.bytes.startswith(b"PK\x01\x02", e - size)):
                    out[begin] = e + 22 + note
        return out

    def walk(self, kind: str, at: int, step) -> int:
        """Follows step from part to part; step gives the next part's place, minus the end's, or 0 if nothing fits."""
        seen = []
        while at > 0 and (kind, at) not in self.dead:
            seen.append((kind, at))
            at = step(at)
            if at < 0:
                return -at
        self.dead.update(seen)
        return 0


def _png(v: _Value, at: int) -> int:
    def step(p: int) -> int:
        if p + 12 > v.n:
            return 0
        n, kind = struct.unpack_from(">I4s", v.bytes, p)
        if p + 12 + n > v.n or zlib.crc32(v.view[p + 4 : p + 8 + n]) != struct.unpack_from(">I", v.bytes, p + 8 + n)[0]:
            return 0
        return -(p + 12 + n) if kind == b"IEND" else p + 12 + n

    head = v.bytes[at + 8 : at + 16] == b"\x00\x00\x00\x0dIHDR"
    return max(0, v.walk("png", at + 8, step) - at) if head else 0


#: The next marker in a JPEG's scan: neither a stuffed zero, a restart nor a fill byte.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _jpeg(v: _Value, at: int) -> int:
    def step(p: int) -> int:
        if p + 2 > v.n or v.bytes[p] != 0xFF:
            return 0
        kind = v.bytes[p + 1]
        if kind == 0xD9:
            return -(p + 2)
        if kind < 0xC0 or kind == 0xD8 or p + 4 > v.n:
            return 0
        n = struct.unpack_from(">H", v.bytes, p + 2)[0]
        if n < 2 or p + 2 + n > v.n:
            return 0
        if kind != 0xDA:
            return p + 2 + n
        found = _MARKER.search(v.bytes, p + 2 + n)
        return found.start() if found else 0

    end = v.walk("jpeg", at + 2, step)
    return end - at if end and v.bytes[at + 3] != 0xD9 else 0


def _gif(v: _Value, at: int) -> int:
    def blocks(p: int) -> int:
        while p < v.n and v.bytes[p]:
            p += v.bytes[p] + 1
        return p + 1

    def step(p: int) -> int:
        if p >= v.n:
            return 0
        if v.bytes[p] == 0x3B:
            return -(p + 1)
        if v.bytes[p] == 0x21:
            return blocks(p + 2)
        if v.bytes[p] == 0x2C and p + 10 <= v.n:
            return blocks(p + 11 + (3 << (v.bytes[p + 9] & 7) + 1 if v.bytes[p + 9] & 128 else 0))
        return 0

    if at + 14 > v.n:
        return 0
    flags = v.bytes[at + 10]
    end = v.walk("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), step)
    return end - at if end else 0


def _bmp(v: _Value, at: int) -> int:
    if at + 30 > v.n:
        return 0
    n, zero, start, head = struct.unpack_from("<IIII", v.bytes, at + 2)
    planes, bits = struct.unpack_from("<HH", v.bytes, at + (22 if head == 12 else 26))
    fits = zero == 0 and head in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (0, 1, 4, 8, 16, 24, 32)
    return n if fits and 14 + head <= start <= n <= v.n - at else 0


def _riff(v: _Value, at: int) -> int:
    if at + 12 > v.n:
        return 0
    n, kind = struct.unpack_from("<I4s", v.bytes, at + 4)
    end = at + 8 + n
    if end > v.n or kind not in _RIFF_KINDS:
        return 0
    p = at + 12
    while p + 8 <= end:
        size = struct.unpack_from("<I", v.bytes, p + 4)[0]
        p += 8 + size + (size & 1)
    return n + 8 if p in (end, end + 1) and (kind != b"WAVE" or _wav(v.bytes[at:end])) else 0


def _pdf(v: _Value, at: int) -> int:
    if not re.match(rb"%PDF-[0-9]\.[0-9]", v.bytes[at : at + 8]):
        return 0
    ends, heads = v.at.get(ENDS[0], []), v.at[b"%PDF-"]
    later = bisect_right(heads, at)
    lo, hi = bisect_right(ends, at), bisect_left(ends, heads[later]) if later < len(heads) else len(ends)
    for e in reversed(ends[lo:hi]):
        last = re.search(rb"startxref\s+(\d{1,10})\s+\Z", v.bytes[max(at, e - 40) : e])
        if last and re.match(rb"xref\b|\d+\s+\d+\s+obj\b", v.bytes[at + int(last[1]) : min(e, at + int(last[1]) + 40)]):
            return e + 5 - at
    return 0


def _zip(v: _Value, at: int) -> int:
    return v.archives.get(at, at) - at


def _gzip(v: _Value, at: int) -> int:
    if at + 18 > v.n or v.bytes[at + 3] & 0xE0:
        return 0
    flags, p = v.bytes[at + 3], at + 10
    if flags & 4:
        p += 2 + struct.unpack_from("<H", v.bytes, p)[0]
    for bit in (8, 16):  # a name and a comment end with a zero
        if flags & bit:
            p = v.zero(p) + 1
            if not p:
                return 0
    if flags & 2:
        p += 2
        if p > v.n or zlib.crc32(v.view[at : p - 2]) & 0xFFFF != struct.unpack_from("<H", v.bytes, p - 2)[0]:
            return 0
    d, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while p < v.n and not d.eof:
            rest = v.view[p : p + 65536]
            p += len(rest)
            while len(rest) and not d.eof:
                out = d.decompress(rest, 1 << 20)
                crc, size, rest = zlib.crc32(out, crc), size + len(out), d.unconsumed_tail
    except zlib.error:
        return 0
    p -= len(d.unused_data)
    return p + 8 - at if d.eof and v.bytes[p : p + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


#: Each byte with its bits reversed: zlib's checksum runs over bits in the other order.
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_page(v: _Value, p: int) -> int:
    """The end of the page at p if its checksum fits, or 0."""
    if p + 27 > v.n or v.bytes[p : p + 5] != b"OggS\x00":
        return 0
    end = p + 27 + v.bytes[p + 26]
    end += sum(v.bytes[p + 27 : end])
    if end > v.n:
        return 0
    page = v.bytes[p : p + 22] + bytes(4) + v.bytes[p + 26 : end]
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return end if f"{crc:032b}"[::-1] == f"{struct.unpack_from('<I', v.bytes, p + 22)[0]:032b}" else 0


def _ogg(v: _Value, at: int) -> int:
    if at + 27 > v.n or not v.bytes[at + 5] & 2:
        return 0
    end = at
    while after := _ogg_page(v, end):
        end = after
    return end - at


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        r = i << bits - 8
        for _ in range(8):
            r = (r << 1 ^ (poly if r >> bits - 1 else 0)) & (1 << bits) - 1
        out.append(r)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(v: _Value, p: int) -> tuple[int, int, int]:
    """Of the frame at p: its header's end, its number (or first sample) and its samples; zeros if its checksum is off."""
    b = v.bytes[p : p + 17]
    if len(b) < 7 or b[0] != 0xFF or b[1] & 0xFE != 0xF8 or b[2] >> 4 == 0 or b[2] & 15 == 15 or b[3] & 1:
        return 0, 0, 0
    more = next((i for i in range(8) if not b[4] >> 7 - i & 1), 8)
    if more in (1, 8) or 4 + max(1, more) >= len(b):
        return 0, 0, 0
    number = b[4] & 0x7F >> more
    for x in b[5 : 4 + max(1, more)]:
        number = number << 6 | x & 0x3F
    q, size = 4 + max(1, more), b[2] >> 4
    extra = {6: 1, 7: 2}.get(size, 0)
    if size == 1:
        samples = 192
    elif size < 6:
        samples = 576 << size - 2
    elif size < 8:
        samples = int.from_bytes(b[q : q + extra], "big") + 1
    else:
        samples = 256 << size - 8
    q += extra + {12: 1, 13: 2, 14: 2}.get(b[2] & 15, 0)
    crc = 0
    for x in b[:q]:
        crc = _CRC8[crc ^ x]
    return (p + q + 1, number, samples) if q < len(b) and crc == b[q] else (0, 0, 0)


def _flac(v: _Value, at: int) -> int:
    p, first = at + 4, True
    total = least = most = 0
    while True:  # metadata blocks, of which the first tells the frames' sizes and the samples
        if p + 4 > v.n:
            return 0
        flags, n = v.bytes[p], int.from_bytes(v.bytes[p + 1 : p + 4], "big")
        if p + 4 + n > v.n or flags & 127 == 127 or first != (flags & 127 == 0) or first and n != 34:
            return 0
        if first:
            least, most = (int.from_bytes(v.bytes[p + a : p + a + 3], "big") for a in (8, 11))
            total = int.from_bytes(v.bytes[p + 17 : p + 22], "big") & (1 << 36) - 1
        first, p = False, p + 4 + n
        if flags & 128:
            break
    done = 0
    while head := _flac_header(v, p)[0]:
        samples, crc, q, end = _flac_header(v, p)[2], 0, p, 0
        last = total and done + samples >= total
        while q < v.n and not (most and q - p >= most):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ v.bytes[q]]
            q += 1
            # over a whole frame with its checksum the sum is 0
            if crc == 0 and q >= head + 2 and q - p >= least:
                if last or _flac_header(v, q)[0]:
                    end = q
                    break
                end = end or (0 if total else q)
        if not end:
            return 0
        done, p = done + samples, end
        if last:
            return p - at
    return p - at if not total and done else 0


_RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
_VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac}


def sniff(value: bytes, start: int = 0) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the media from start on, in order; what lies inside a found one is part of it."""
    v, found, free = _Value(value), [], start
    for at, magic in sorted((p, m) for m, places in v.at.items() if m in MAGIC for p in places):
        if at < free:
            continue
        kind = MAGIC[magic]
        if n := _VALID[kind](v, at):
            found.append((at, n, _RIFF_KINDS[value[at + 8 : at + 12]] if kind == "riff" else kind))
            free = at + n
    return found


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples. The payload's length is even."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def _wav(value: bytes) -> tuple[int, int, str] | None:
    """Where a WAV file's samples begin and end, and their form; None without both a whole format and a data chunk."""
    at, form = 12, None
    while at + 8 <= len(value):
        kind, n = struct.unpack_from("<4sI", value, at)
        if kind == b"fmt " and n >= 16 and at + 24 <= len(value):
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", value, at + 8)
            form = f"channels={channels};rate={rate};bits={bits}"
        if kind == b"data":
            return (at + 8, min(at + 8 + n, len(value)), form) if form else None
        at += 8 + n + (n & 1)
    return None


def wav_samples(value: bytes) -> tuple[bytes, str]:
    """The data chunk and a description of a WAV file's samples; nothing if it isn't one."""
    found = _wav(value)
    return (value[found[0] : found[1]], found[2]) if found else (b"", "")


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def _batches(schema: list[str], rows: Iterator[tuple], types: list[pa.DataType], weigh) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > _FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], schema)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the stored form) and declared (its type as a careless writer would give it)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, len(t), to_wav(pad(t)), "application/octet-stream") for b in batches for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))))
        yield from _batches(["id", "n_bytes", "media", "declared"], rows, [pa.int64(), pa.int64(), pa.binary(), pa.string()], lambda r: len(r[2]))

    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary, declared string")


def inspect(stored: DataFrame) -> DataFrame:
    """stored with type (the corrected one), payload and feature (type, sample form, levels and embedded media)."""

    def row(i, n, media, declared):
        if media is None:
            return i, n, None, declared, None, None, None
        found = sniff(media)
        kind = found[0][2] if found and found[0][:2] == (0, len(media)) else declared
        payload, form = wav_samples(media) if kind == "audio/wav" else (media, "")
        inner = sniff(payload)
        feature = f"{kind};{form};samples={len(payload)};low={min(payload, default=0)};high={max(payload, default=0)};zeros={payload.count(0)};embedded=" + ",".join(f"{k}@{a}+{m}" for a, m, k in inner)
        return i, n, media, declared, kind, payload, feature

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(i.as_py(), n.as_py(), m.as_py(), d.as_py()) for b in batches for i, n, m, d in zip(*b.columns))
        yield from _batches(["id", "n_bytes", "media", "declared", "type", "payload", "feature"], rows, [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.string()], lambda r: 2 * len(r[2] or b""))

    return stored.select("id", "n_bytes", "media", "declared").mapInArrow(run, "id long, n_bytes long, media binary, declared string, type string, payload binary, feature string")


def carve(media: DataFrame, id_col: str = "id", value_col: str = "media") -> DataFrame:
    """id, offset, type and bytes of the media embedded in values (a value that is one whole medium is looked into too)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                    value = v.as_py() or b""
                    for at, n, kind in sniff(value):
                        whole = (at, n) == (0, len(value))
                        yield from ((i, a, k, value[a : a + m]) for a, m, k in (sniff(value, 1) if whole else [(at, n, kind)]))

        yield from _batches(["id", "offset", "type", "bytes"], rows(), [pa.int64(), pa.int64(), pa.string(), pa.binary()], lambda r: len(r[3]))

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("v")).mapInArrow(run, "id long, offset long, type string, bytes binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    out = inspect(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
