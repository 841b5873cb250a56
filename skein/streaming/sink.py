"""A log table as a data source of its own: format("loglines"), for frames and streams.

Each task stages one file; the driver's commit gives the files of a write their names, and of a stream's batch the number of
the batch, after it has removed what an earlier try of the batch may have left. A task that fails or is tried again leaves a
staged file that no reader sees, and abort removes it: each line is in the table once. Files are Parquet, reached through
Arrow's file systems (file, hdfs, s3, ..), in the folder that driver and executors share; read them with
spark.read.parquet(path).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Spark passes over folders with this prefix.
STAGED = "_staged"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """A task's file (none, if it had no rows) and its rows."""

    file: str | None
    rows: int


class _Files:
    """What both writers do with files."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        where, root = _at(self.path)
        name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if writer is None:
                    where.create_dir(f"{root}/{STAGED}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{STAGED}/{name}", b.schema, filesystem=where)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Staged(name if writer is not None else None, rows)

    def publish(self, messages: list[Staged | None], prefix: str) -> None:
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        for f in where.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(f"{prefix}-"):
                where.delete_file(f.path)
        for i, m in enumerate(m for m in messages if m is not None and m.file):
            where.move(f"{root}/{STAGED}/{m.file}", f"{root}/{prefix}-{i:05d}.parquet")

    def drop(self, messages: list[Staged | None]) -> None:
        where, root = _at(self.path)
        for m in messages:
            if m is not None and m.file and where.get_file_info(f"{root}/{STAGED}/{m.file}").type == fs.FileType.File:
                where.delete_file(f"{root}/{STAGED}/{m.file}")


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.files, self.overwrite = _Files(path, schema), overwrite
        self.name = f"rows-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.files.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        if self.overwrite:
            where, root = _at(self.files.path)
            for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.base_name.endswith(".parquet"):
                    where.delete_file(f.path)
        self.files.publish(messages, self.name)

    def abort(self, messages: list[Staged | None]) -> None:
        self.files.drop(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType, query: str) -> None:
        self.files, self.query = _Files(path, schema), query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.files.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.files.publish(messages, f"{self.query}-{batchId:09d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.files.drop(messages)


class LogLines(DataSource):
    """Options: path; query, a name that tells apart streams that write to one table (default: stream)."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], schema, self.options.get("query", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogLines)
