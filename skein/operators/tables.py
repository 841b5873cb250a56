"""Tables as immutable frames: upsert, delete, pages, retention, logs, progress, exports; groups of tables that are written together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The share of each stage in the overall progress.
STAGE_WEIGHTS = {"ingestion": 25, "preprocessing": 25, "clustering": 35, "graph": 15}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old that new doesn't name, and all of new."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti").select(old.columns)


def updated(df: DataFrame, where: Column, **values) -> DataFrame:
    """df with new values in the rows where a condition holds; other rows keep theirs."""
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(dict(df.dtypes)[c]) for c, v in values.items()})


def assign(df: DataFrame, assignments: DataFrame, key: str, column: str) -> DataFrame:
    """df with a column's values taken from assignments (key, column) where these have the row; a batch of updates."""
    new = assignments.select(F.col(key).alias("__key"), F.col(column).alias("__new"), F.lit(True).alias("__has"))
    out = df.join(new, F.col(key) == F.col("__key"), "left").withColumn(column, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(column)))
    return out.select(df.columns)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def healthy(spark) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1").first()[0] == 1


class Group:
    """Tables of a folder that change together: what is written within one `with` block is read after it, or none of it.

    Each block writes its tables to a folder of its own; its commit is one file, <folder>/_commits/<number>, that names the
    folder of every table. The file is created only if it isn't there, so of two blocks that began alike the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, dict[str, str]]:
        where, fs = self._fs(f"{self.folder}/_commits")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()] if fs.exists(where) else []
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/_commits/{max(numbers)}").first()[0])

    def read(self, name: str) -> DataFrame:
        """The table as the last commit left it; KeyError if there is none."""
        return self.spark.read.parquet(self._last()[1][name])

    def __enter__(self) -> Group:
        self.number, self.paths = self._last()
        self.staged = f"{self.folder}/{uuid.uuid4().hex}"
        return self

    def write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.staged}/{name}")
        self.paths = self.paths | {name: f"{self.staged}/{name}"}

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                where, fs = self._fs(f"{self.folder}/_commits/{self.number + 1}")
                out = fs.create(where, False)
                out.write(json.dumps(self.paths).encode())
                out.close()
                return
        except Exception:
            self._undo()
            raise
        self._undo()

    def _undo(self) -> None:
        where, fs = self._fs(self.staged)
        fs.delete(where, True)


def page(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def newest(df: DataFrame, time: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def keep_latest(runs: DataFrame, group: str, time: str, keep: int, tie: str) -> DataFrame:
    """The runs beyond the newest `keep` of their group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), F.desc(tie)))
    return runs.withColumn("rank", rank).filter(F.col("rank") > keep)


def older_than(runs: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    return runs.filter(F.col(time) < as_of - F.make_dt_interval(days=F.lit(days)))


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key: one aggregate with map-side combine."""
    others = [c for c in df.columns if c not in order and c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *others)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *others)])


def overall_progress(stages: DataFrame) -> DataFrame:
    """progress of (stage, status, progress): weighted, a completed stage counting 100, clamped to 0..100."""
    weight = F.create_map(*[F.lit(x) for kv in STAGE_WEIGHTS.items() for x in kv])
    done = F.when(F.col("status") == "completed", 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress").cast("double"))))
    return stages.agg(F.round(F.sum(weight[F.col("stage")] * done) / 100, 6).alias("overall"))


def export_rows(df: DataFrame) -> DataFrame:
    """Arrays joined by '; ', everything else as text; for a CSV writer with quotes doubled."""
    return df.select(*[F.array_join(F.col(c), "; ").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
