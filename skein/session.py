"""The Spark session and the engine's views of the driver tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("skein")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_idx, title, raw_text, categories, cluster_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc_idx"), F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("raw_text"), F.array("lang", "source").alias("categories"), F.regexp_replace("source", "src", "").cast("int").alias("cluster_id"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that have a vector: doc_idx, title, raw_text, categories, links, embedding, and the vector's cluster_id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cluster_id"))
    a = articles(spark, sf_dir).drop("cluster_id").withColumn("links", F.regexp_extract_all("raw_text", F.lit("([A-Z][a-z]+) [a-z]+"), 1))
    return a.join(v, "doc_idx")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_idx, title, embedding (double), cluster_id."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("doc_idx"), F.concat(F.lit("Vec_"), F.col("vec_id").cast("string")).alias("title"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cluster_id"))


def links(v: DataFrame) -> DataFrame:
    """src and dst titles: each vector i points to i + 1 and 7 i + 3, modulo their number."""
    n = F.broadcast(v.agg(F.count("*").alias("n")))  # one row
    return v.crossJoin(n).select(F.col("title").alias("src"), F.explode(F.array((F.col("doc_idx") + 1) % F.col("n"), (F.col("doc_idx") * 7 + 3) % F.col("n"))).alias("d")).select("src", F.concat(F.lit("Vec_"), F.col("d").cast("string")).alias("dst"))
