"""Sources and sinks: JSON lines, CSV, graph folders, snapshots; api.py has web sources, stores.py databases, models and reports."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "title string, text string, categories array<string>, links array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", per_file: int = 0) -> None:
    """JSON lines; with per_file, a file is closed after so many, so that a broken run loses fewer at most."""
    df.write.mode(mode).option("maxRecordsPerFile", per_file).json(path)


def resume(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame:
    """fresh without the titles already in path."""
    return fresh.join(read_jsonl(spark, path).select("title"), "title", "left_anti")


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and doubled quotes; an empty frame is an error."""
    if df.isEmpty():
        raise ValueError("nothing to export")
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def snapshot(spark: SparkSession, paths: dict[str, str], target: str) -> None:
    """Copies tables (summaries too) as the baseline of later runs."""
    for name, path in paths.items():
        spark.read.parquet(path).write.mode("overwrite").parquet(f"{target}/{name}")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def stage_status(spark: SparkSession, artifacts: dict[str, list[str]]) -> DataFrame:
    """stage, has_artifacts (all of its paths are there), size and last_modified of the stages' files."""
    out = []
    for stage, paths in artifacts.items():
        size, latest, there = 0, 0, True
        for path in paths:
            root = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
            there = there and fs.exists(root)
            if there:
                size += fs.getContentSummary(root).getLength()
                latest = max(latest, fs.getFileStatus(root).getModificationTime())
        out.append((stage, there, size if there else 0, latest if there else None))
    rows = spark.createDataFrame(out, "stage string, has_artifacts boolean, size long, ms long")
    return rows.select("stage", "has_artifacts", "size", F.timestamp_millis("ms").alias("last_modified"))


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, draw: Callable[[], float] = random.random) -> float:
    return min(most, base * 2**attempt) * (0.8 + 0.4 * draw())


class TokenBucket:
    """At most `rate` a second, bursts of half of that, for one partition's reader."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.burst, self.clock = rate, max(1.0, rate / 2), clock
        self.tokens, self.at = self.burst, clock()

    def wait(self) -> float:
        """Seconds to wait before the next request."""
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        self.tokens -= 1
        return max(0.0, -self.tokens / self.rate)
