"""Byte-level BPE: encoding by a local rank file with the tiktoken library, decoding to raw bytes.

Texts over LONG characters are split first where the split pattern always ends a match: between a letter and what is no
letter (ASCII, or common marks of Chinese and Japanese). Long runs of white space, on which the pattern's look-ahead
would fail, are one match but for the last character before more text, and are merged by themselves. Each part is
encoded by itself, so the ids equal those of the whole text. A part without such a place stays whole: it is one match,
or few.

Defined results: a null text is an empty one (no ids, no bytes). Repeated rows and null ids keep their rows. Ids come
back as array<int>, bytes as binary.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, trimmed, utf8

LONG = 1 << 16
_SAFE = re.compile("(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[\\x00-@\\[-`{-\x7f\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: White space to the split pattern: Python's own class has four separators more.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Ids gathered before a batch goes back to Spark.
_FLUSH = 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about `long` characters, cut only at safe boundaries."""
    at = 0
    while len(text) - at > long and (cut := _SAFE.search(text, at + long)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def ids_of(enc: tiktoken.Encoding, text: str, long: int = LONG) -> list[int]:
    """The ids of a text, encoded in parts if it is long."""
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for gap in re.finditer(_SPACE + "{%d,}" % max(2, long // 2), text):
        end = gap.end() - (gap.end() < len(text))
        out += [x for p in parts(text[at : gap.start()], long) for x in enc.encode_ordinary(p)]
        out += enc._encode_single_piece(text[gap.start() : end])
        at = end
    return out + [x for p in parts(text[at:], long) for x in enc.encode_ordinary(p)]


def _encoder(path: str, pattern: str, long: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out, size, first = [], 0, 0
            for i, text in enumerate(utf8(batch.column(1))):
                text = text.decode("utf-8", "replace")
                ids = ids_of(enc, text, long)
                out.append(pa.array(ids, pa.int32()))
                size += len(ids)
                if size >= _FLUSH:
                    yield _lists(batch.column(0).slice(first, i + 1 - first), out)
                    out, size, first = [], 0, i + 1
            yield _lists(batch.column(0).slice(first), out)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """id and ids (array<int>) of each row's whole text."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_encoder(path, pattern, long), "id long, ids array<int>")


def _lists(ids: pa.Array, lists: list[pa.Array]) -> pa.RecordBatch:
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "ids"])


def _decoder(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw, size, first = [], 0, 0
            for i, ids in enumerate(batch.column(1)):
                raw.append(enc.decode_bytes(ids.values.to_numpy().tolist()) if ids.is_valid else b"")
                size += len(raw[-1])
                if size >= 4 * _FLUSH:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(raw)) for c in batch.columns), pa.array(raw, pa.binary())], ["id", "ids", "bytes"])
                    raw, size, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*(c.slice(first) for c in batch.columns), pa.array(raw, pa.binary())], ["id", "ids", "bytes"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """id, ids and bytes: the raw bytes that the ids stand for."""
    return encoded.select("id", "ids").mapInArrow(_decoder(path, pattern), "id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """decode() of encode(), by one worker a task: there is one copy of the ranks, and ids don't pass through Spark between."""
    lean(docs.sparkSession)
    to, back = _encoder(path, pattern, long), _decoder(path, pattern)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: back(to(batches)), "id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The digest columns of op7, derived from what encode() and decode() make."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = round_trip(docs, path, pattern)
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
