"""Token ids in Arrow files of fixed-size lists.

Every range of documents (ascending id) is one shard: `shard-00007.arrow`, an Arrow IPC file whose record batches hold
fixed-size lists `ids` (uint16, or uint32 for larger vocabularies) and `mask` (one bit each), all of the same length, so that sequence i is found by arithmetic
and read without a copy from a memory map; `shard-00007.docs.arrow` lists doc_id, start and n_tokens of the shard's
documents. The last sequence of a shard is padded, with mask 0. A shard is written under a name of its own attempt
and moved into place, so a repeated task only replaces it by the same bytes. Files go through pyarrow.fs to the folder
that the driver and all executors share.

Texts are encoded by the tokenizers library. Its normalization (composition, lower case) and splitting never look across
ASCII white space, so each distinct run of other characters is encoded once and put together again by array operations. This
holds for tokenizers that drop white space and lower-case, as the vocabulary used here does.

Defined results: a null or empty text has just the end id. Rows with a null id come first. Repeated rows each have
their ids. An empty table makes no sequences. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, new_path, slices, trimmed

LENGTH, BATCH = 2048, 64
_MEMO = 480_000
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def schema(length: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


#: Lower-case ASCII, and Latin-1 letters of either case: their composition and lower case don't depend on their neighbours.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet: bytes without a visible Latin-1 character stand at 256 and up, in their order.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class Encoder:
    """Ids of texts, with a memo of the ids of runs between white space, which starts anew when it is full."""

    def __init__(self, path: str, end: int) -> None:
        self.tokenizer, self.end = tokenizer(path), end
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        # run -> number; the ids of number i are pool[at[i] : at[i + 1]]. Number 0 is the end of a text.
        self.memo: dict[bytes, int] = {}
        self.pool, self.at = np.array([self.end], self.kind), np.array([0, 1])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end, and how many each text has."""
        starts, distinct, which = runs(texts)
        if len(self.memo) > _MEMO:
            self.clear()
        new = [w for w in distinct if w not in self.memo]
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        memo = self.memo
        number = np.fromiter((memo[w] for w in distinct), np.int64, len(distinct))
        each = np.insert(number[which], starts[1:], 0)
        n = np.diff(self.at)[each]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[each] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.add.reduceat(n, starts[:-1] + np.arange(len(texts))) if len(texts) else n

    def learn(self, words: list[bytes]) -> None:
        """Adds the ids of words. Runs of Latin letters are one piece to the splitting, so they go straight to the merges; the
        others are encoded joined by blanks in one text, and the ids' offsets tell whose they are."""
        plain = [w.decode("utf-8", "replace") for w in words]
        tokenize, ids, other = self.tokenizer.model.tokenize, [], []
        for k, w in enumerate(plain):
            if _LETTERS.fullmatch(w):
                ids.append([t.id for t in tokenize(w if w.isascii() else w.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))])
            else:
                ids.append(None)
                other.append(k)
        if other:
            found = self.tokenizer.encode(" ".join(plain[k] for k in other), add_special_tokens=False)
            at = np.array([a for a, _ in found.offsets], np.int64)
            cuts = np.searchsorted(at, np.cumsum([0, *(len(plain[k]) + 1 for k in other)])).tolist()
            flat = found.ids
            for k, a, b in zip(other, cuts, cuts[1:]):
                ids[k] = flat[a:b]
        self.memo.update((w, len(self.at) - 1 + i) for i, w in enumerate(words))
        self.at = np.concatenate((self.at, len(self.pool) + np.cumsum([len(x) for x in ids])))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(ids), self.kind)))


def runs(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Where each text's runs between ASCII white space begin (and the last one's end), the distinct runs, and each run's
    number among them. A-Z are lowered first, as the normalizer does, unless that might make a special token."""
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
        # a point or comma between an ASCII letter and white space is a piece of its own: set apart, there are fewer distinct runs
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,])([ \n])", r"\1 \2\3")
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """One for each Python worker, so that its tasks share the memo."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path, end)


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Shard:
    """Writes sequences as ids come; at most one batch of them is held."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, length: int, kind: type) -> None:
        self.length, self.out, self.schema = length, fs.open_output_stream(path), schema(length, kind)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH:
            flat = np.concatenate(self.held)
            full = len(flat) // (self.length * BATCH) * self.length * BATCH
            for i in range(0, full, self.length * BATCH):
                self._write(flat[i : i + self.length * BATCH], None)
            self.held, self.n = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, used: int | None) -> None:
        mask = np.ones(len(flat), bool)
        if used is not None:
            mask[used:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()
        self.out.close()


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes the shards; returns their manifest (shard, n_docs, n_ids, base: ids in all shards before), one row each."""
    spark = lean(docs.sparkSession)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = _fs(folder)
        name, names = f"{root}/shard-{shard:05d}", []
        out = index = code = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                code = encoder(vocabulary, end)
                out = _Shard(fs, f"{name}.arrow.{attempt}", length, code.kind)
                index = pa.ipc.new_file(sink := fs.open_output_stream(f"{name}.docs.arrow.{attempt}"), _DOCS)
                names = [f"{name}.arrow", f"{name}.docs.arrow"]
            counts, before = [], out.total
            for texts in slices(batch.column(1)):
                ids, n = code(texts)
                out.add(ids)
                counts.append(n)
            counts = np.concatenate(counts)
            starts = before + np.cumsum(counts) - counts
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=_DOCS))
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            for x in names:
                fs.move(f"{x}.{attempt}", x)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    shards = sorted(map(tuple, rows.mapInArrow(run, "shard long, n_docs long, n_ids long").collect()))  # one row per shard
    base, manifest = 0, []
    for shard, n_docs, n_ids in shards:
        manifest.append((shard, n_docs, n_ids, base))
        base += n_ids
    return spark.createDataFrame(manifest, "shard long, n_docs long, n_ids long, base long")


def sequences(path: str) -> tuple[pa.ipc.RecordBatchFileReader, int]:
    """A memory-mapped shard and its number of sequences."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    return reader, sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Sequence i and its mask, as views of the mapped file (all batches but the last hold BATCH sequences)."""
    batch = reader.get_batch(i // BATCH)
    ids, mask = (batch.column(k).slice(i % BATCH, 1).flatten() for k in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian uint32) from the shards' files."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/shard-{shard:05d}.docs.arrow") as f, fs.open_input_file(f"{root}/shard-{shard:05d}.arrow") as g:
                    index, ids = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    flow = _stream(ids)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        counts = docs.column(2).to_pylist()
                        out, first, size = [], 0, 0
                        for k, n in enumerate(counts):
                            out.append(flow(n))
                            size += n
                            if size > 1 << 20 or k + 1 == len(counts):
                                part = docs.slice(first, k + 1 - first)
                                starts = pa.array(part.column(1).to_numpy() + base)
                                yield pa.RecordBatch.from_arrays([part.column(0), starts, pa.array(out, pa.binary())], ["doc_id", "start", "ids"])
                                out, first, size = [], k + 1, 0

    n = max(1, manifest.count())
    return manifest.select("shard", "base").repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def _stream(reader: pa.ipc.RecordBatchFileReader):
    """A function that gives the bytes of the next n ids; the mask tells which are padding."""
    held, batch = b"", 0

    def take(n: int) -> bytes:
        nonlocal held, batch
        out = []
        while n:
            if not held:
                b = reader.get_batch(batch)
                batch += 1
                flat = b.column(0).flatten().to_numpy(zero_copy_only=True)
                used = b.column(1).flatten().true_count  # padding stands at the end
                held = memoryview(flat[:used].astype("<u4")).cast("B")
            got = held[: 4 * n]
            out.append(bytes(got))
            held = held[len(got) :]
            n -= len(got) // 4
        return b"".join(out)

    return take


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "tokens")
    back = read(spark, write(docs, folder, public_tokenizers.path("word_bpe_49k.json")), folder)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
