"""Tables in databases, model and report folders, configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds, read by several connections."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_model(path: str, labels: DataFrame, centers: DataFrame, model: KMeansModel | None = None, **about) -> None:
    """Labels, centers and, if there is one, the fitted model, with what else is known of it."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    about["fitted"] = model is not None
    labels.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, KMeansModel | None, dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = KMeansModel.load(f"{path}/model") if about.pop("fitted") else None
    return spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/centers"), model, about


def coerced(value):
    """A value that JSON can hold: array scalars as numbers, dates as ISO text, other things as text; keys as text; what is no
    number is null."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {str(k): coerced(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [coerced(v) for v in value]
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document in a folder that all executors share."""
    spark.createDataFrame([(json.dumps(coerced(value), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))  # one document


def write_report(spark: SparkSession, metrics: dict, path: str) -> None:
    write_json(spark, metrics, path)


def read_report(spark: SparkSession, path: str) -> dict | None:
    """A drift report, or None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read_json(spark, path) if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root) else None


def metrics_text(df: DataFrame) -> DataFrame:
    """Rows as JSON text: NaN and infinite numbers are null, decimals doubles, times ISO text."""
    out = []
    for c, t in df.dtypes:
        x = F.col(c)
        if t in ("double", "float"):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
        out.append((x.cast("double") if t.startswith("decimal") else F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else x).alias(c))
    return df.select(F.to_json(F.struct(*out)).alias("value"))


@dataclass
class Config:
    """The settings of a run; from_file() reads JSON, or YAML where a parser is installed."""

    queries: list[str] = field(default_factory=list)
    per_query: int = 50
    max_articles: int = 1000
    stub_min_words: int = 200
    threshold: float = 0.7
    method: str = "auto"
    adaptive: bool = True
    n_clusters: int = 100
    rate: float = 50.0
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in values.items() if k in known}, extra={k: v for k, v in values.items() if k not in known})

    @classmethod
    def from_file(cls, path: str) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text))

    def to_file(self, path: str) -> None:
        """Rewrites the file; settings that it doesn't know stay in it."""
        values = asdict(self)
        Path(path).write_text(json.dumps(values.pop("extra") | values, indent=2, ensure_ascii=False), encoding="utf-8")
