"""Structured Streaming twins: request metrics by window, progress on change, log append, incremental ingest, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import sink


def request_windows(requests: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, mean latency and errors by window (sliding, if slide is given) and endpoint of a frame or stream (timestamp,
    endpoint, latency_ms, status_code)."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    grouped = requests.withWatermark("timestamp", late).groupBy(w, "endpoint") if requests.isStreaming else requests.groupBy(w, "endpoint")
    return grouped.agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("avg_ms"), F.count_if(F.col("status_code") >= 400).alias("errors")).select(F.col("window.start").alias("start"), "endpoint", "requests", "avg_ms", "errors")


def progress_changes(states: DataFrame) -> DataFrame:
    """Progress states (run_id, state, timestamp) as a feed hands them on: without those that repeat the one before. A state
    that comes back later is a change again. A stream keeps each run's last state only."""
    if not states.isStreaming:
        before = F.lag("state").over(Window.partitionBy("run_id").orderBy("timestamp"))
        return states.select("run_id", "state", "timestamp", before.alias("b")).filter("b is null or b <> state").drop("b")

    def changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("timestamp", kind="stable")
        keep = rows["state"] != rows["state"].shift(fill_value=last)
        state.update((rows["state"].iloc[-1],))
        yield rows[keep][["run_id", "state", "timestamp"]]

    named = states.select("run_id", "state", "timestamp")
    return named.groupBy("run_id").applyInPandasWithState(changes, named.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def done(states: DataFrame) -> DataFrame:
    """run_id of the runs of which every stage (run_id, stage, status) is completed or failed, where a feed closes."""
    return states.groupBy("run_id").agg(F.bool_and(F.col("status").isin("completed", "error")).alias("all")).filter("all").select("run_id")


def append_lines(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Text lines appended to a log table; DEBUG lines are left out."""
    lines = spark.readStream.text(source).filter(~F.col("value").startswith("DEBUG:"))
    return append(lines, target, checkpoint)


def append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows, as they become final, into a parquet table; works off what is there and ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def append_logs(rows: DataFrame, target: str) -> None:
    """Log rows appended to a table; a task that is tried again adds no row twice."""
    sink.register(rows.sparkSession)
    rows.write.format("loglines").mode("append").save(target)


def stream_logs(stream: DataFrame, target: str, checkpoint: str, query: str = "stream") -> StreamingQuery:
    """A stream's rows into the log table; a batch that is tried again replaces what it left. Works off what is there."""
    sink.register(stream.sparkSession)
    return stream.writeStream.format("loglines").option("query", query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """New JSON-line files into a table; a rerun goes on where the last one stopped."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_trigger).json(source)
    return append(rows, target, checkpoint)


def ingest_kept(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame], interval: int = 1000, per_trigger: int = 1000) -> StreamingQuery:
    """New JSON-line files into <target>/articles/batch=<n>, only what keep() leaves of them, in files of `interval` articles
    at most; and after each batch a row of <target>/checkpoints: batch, kept, total, and marks, the multiples of `interval`
    that the total has passed. A batch that is tried again replaces its own rows, so a rerun goes on with the right total.
    """
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_trigger).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        where = f"{target}/articles/batch={number}"
        keep(batch).write.mode("overwrite").option("maxRecordsPerFile", interval).parquet(where)
        kept = own.read.parquet(where).count()
        before = own.read.parquet(f"{target}/checkpoints/{number - 1}").first()["total"] if number else 0
        row = (number, kept, before + kept, (before + kept) // interval)
        own.createDataFrame([row], "batch long, kept long, total long, marks long").coalesce(1).write.mode("overwrite").parquet(f"{target}/checkpoints/{number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def retain(stream: DataFrame, target: str, checkpoint: str, n: int = 10_000, time: str = "timestamp", tie: str = "id", versions: int = 2) -> StreamingQuery:
    """The newest n rows seen so far, one version of the table for each batch: <target>/<batch>. A version holds n rows at
    most and is made from the one before and the batch's own newest; rows that fall out are gone.

    Only the last versions stay (two at least: a batch that is tried again reads the one before), so that files are bounded
    however long the stream runs.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.orderBy(F.desc(time), F.desc(tie)).limit(n)
        if number:
            newest = spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}").unionByName(newest).orderBy(F.desc(time), F.desc(tie)).limit(n)
        newest.write.mode("overwrite").parquet(f"{target}/{number}")
        if number >= max(2, versions):
            _remove(spark, f"{target}/{number - max(2, versions)}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Newest(StatefulProcessor):
    """The newest rows of a key, as one list that never holds more than n."""

    def __init__(self, n: int, time: str, columns: list[str], schema: str) -> None:
        self.n, self.time, self.columns, self.schema = n, time, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = pd.DataFrame(list(self.kept.get()) if self.kept.exists() else [], columns=self.columns)
        new = pd.concat(list(rows))[self.columns]
        both = pd.concat([before, new]) if len(before) else new
        both = both.sort_values(self.time, kind="stable").tail(self.n)
        self.kept.put([tuple(r) for r in both.itertuples(index=False)])
        yield both

    def close(self) -> None:
        pass


def newest_by_key(stream: DataFrame, key: str, n: int = 1000, time: str = "timestamp") -> DataFrame:
    """After each batch the newest n rows of every key that it has, from state of n rows a key; for output mode update. It
    needs the RocksDB state store, which is set for the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(_Newest(n, time, stream.columns, schema), schema, "Update", "None")


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and reads its final rows: those of windows that the watermark has closed."""
    append(stream, target, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
