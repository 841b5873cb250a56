"""Drift and stability runs over stored tables: compute, log, report, and take the next baseline.

A run reads tables from folders that Spark reaches (a table that isn't there is left out), writes its numbers as rows of a
metrics table, its report as JSON, and the current tables as the baseline of the next run.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshot
from ..sources.stores import write_report
from . import monitoring

TABLES = ("embeddings", "articles", "assignments", "summaries")
log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def tables_in(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of a folder by name, those that are there and can be opened."""
    out = {}
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            try:
                out[name] = spark.read.parquet(f"{folder}/{name}")
            except Exception as e:
                log.warning("%s of %s can't be opened: %s", name, folder, e)
    return out


def _logged(spark: SparkSession, metrics: dict, prefix: str, run_id: str, target: str | None, booleans: bool = False) -> None:
    rows = [(run_id, f"{prefix}_{k}", v) for k, v in monitoring.numeric(metrics, booleans).items()]
    if target and rows:
        spark.createDataFrame(rows, "run_id string, metric string, value double").coalesce(1).write.mode("append").parquet(target)


def run_drift(spark: SparkSession, baseline: str, current: str, run_id: str, metrics_to: str | None = None, report_to: str | None = None, threshold: float = 0.3, save_baseline: bool = True) -> dict:
    """The drift of the current tables against the baseline's: figures, decision and threshold.

    Without baseline vectors the result is that there is no drift, for the reason "no_baseline". Figures are logged as
    drift_<name> (the decision as 0 or 1), the report is written whatever the result, and the current tables become the
    baseline unless save_baseline is off.
    """
    found = monitoring.drift_metrics(tables_in(spark, baseline), tables_in(spark, current), threshold)
    _logged(spark, found | {"drift_detected": bool(found["drift_detected"])}, "drift", run_id, metrics_to, booleans=True)
    if report_to:
        write_report(spark, found, report_to)
    if save_baseline:
        snapshot(spark, {n: f"{current}/{n}" for n in tables_in(spark, current)}, baseline)
    return found


def stability(base: dict[str, DataFrame], now: dict[str, DataFrame]) -> dict:
    """Agreement of two assignments (title, cluster_id), and with summaries on both sides (cluster_id, size) the clusters'
    evolution, named evolution_; stability_calculated says whether it could be told, and why not."""
    if "assignments" not in base:
        return {"stability_calculated": False, "reason": "no_baseline"}
    try:
        label = lambda df: df.select("title", F.col("cluster_id").alias("label"))
        out = monitoring.stability(label(base["assignments"]), label(now["assignments"])).first().asDict()
        if "summaries" in base and "summaries" in now:
            out |= {f"evolution_{k}": v for k, v in monitoring.evolution_totals(base["summaries"], now["summaries"]).first().asDict().items()}
        return out | {"stability_calculated": True}
    except Exception as e:
        log.warning("the stability can't be told: %s", e)
        return {"stability_calculated": False, "error": str(e)}


def run_stability(spark: SparkSession, baseline: str, current: str, run_id: str, metrics_to: str | None = None) -> dict:
    """stability() of two folders; its numbers are logged as stability_<name> if it could be told."""
    found = stability(tables_in(spark, baseline), tables_in(spark, current))
    if found["stability_calculated"]:
        _logged(spark, found, "stability", run_id, metrics_to)
    return found
