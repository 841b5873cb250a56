"""Run tracking on tables: experiments, runs, metrics, cleanup, and the log store.

Tables: experiments (experiment_id, name, tags map), runs (run_id, experiment_id, start_time, status, info), metrics
(run_id, metric, value), logs (run_id, id, log_level, message, ...). Every function returns new frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import older_than

#: What the description of a run broken by a schema change holds.
BROKEN = ["migration", "alembic", "revision"]


def listing(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiments with the number of their runs and the time of the newest."""
    per = runs.groupBy("experiment_id").agg(F.count("*").alias("run_count"), F.max("start_time").alias("last_run"))
    return experiments.join(per, "experiment_id", "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def to_clean(runs: DataFrame, as_of: Column | None = None, days_old: int | None = None, keep_latest: int | None = None) -> DataFrame:
    """run_id of the runs to delete, once each: those older than days_old, or, if keep_latest is given, instead those
    beyond the newest keep_latest of their experiment."""
    if keep_latest is not None:
        rank = F.row_number().over(Window.partitionBy("experiment_id").orderBy(F.desc("start_time"), F.desc("run_id")))
        return runs.withColumn("rank", rank).filter(F.col("rank") > keep_latest).select("run_id").distinct()
    if days_old is not None and as_of is not None:
        return older_than(runs, "start_time", as_of, days_old).select("run_id").distinct()
    return runs.select("run_id").limit(0)


def cleanup(runs: DataFrame, gone: DataFrame, dry_run: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """The runs left, and counts of found, deleted (or, on a dry run, would_delete) and kept ones."""
    found, n = runs.count(), gone.count()
    if dry_run:
        return runs, {"found": found, "deleted": 0, "would_delete": n, "kept": found - n}
    return runs.join(gone, "run_id", "left_anti").select(runs.columns), {"found": found, "deleted": n, "kept": found - n}


def corrupted(runs: DataFrame) -> DataFrame:
    """run_id of failed runs whose description tells of a schema change, and of runs without a status."""
    told = F.lower(F.coalesce("info", F.lit(""))).rlike("|".join(BROKEN))
    return runs.filter(F.col("status").isNull() | ((F.col("status") == "FAILED") & told)).select("run_id").distinct()


def tag(experiments: DataFrame, name: str, tags: dict[str, str]) -> DataFrame:
    """experiments with tags added to the one of that name; a new value takes an old one's place."""
    new = F.create_map(*[F.lit(str(x)) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    old = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(list(tags))), new) if tags else old
    return experiments.withColumn("tags", F.when(F.col("name") == name, merged).otherwise(F.col("tags")))


def metrics_summary(runs: DataFrame, metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row a run: run_id, status, start_time and a column for each metric, the value of the last step."""
    step = F.col("step") if "step" in metrics.columns else F.lit(0)
    last = metrics.groupBy("run_id", "metric").agg(F.max(F.struct(step.alias("step"), F.col("value"))).alias("m")).select("run_id", "metric", "m.value")
    wide = last.groupBy("run_id").pivot("metric", names).agg(F.first("value"))
    return runs.select("run_id", "status", "start_time").join(wide, "run_id", "left")


def log_metrics(metrics: DataFrame, run_id: str, values: DataFrame, prefix: str = "") -> DataFrame:
    """metrics and the rows (metric, value) of a run, named with the prefix."""
    name = F.concat(F.lit(f"{prefix}_"), F.col("metric")) if prefix else F.col("metric")
    return metrics.unionByName(values.select(F.lit(run_id).alias("run_id"), F.translate(name, "/-", "__").alias("metric"), F.col("value").cast("double").alias("value")))


def start(runs: DataFrame, run_id: str, at: Column) -> DataFrame:
    """runs (run_id, started_at, status, current_stage) with a new running one, in place of one of the same id."""
    new = runs.sparkSession.createDataFrame([(run_id,)], "run_id string").select("run_id", at.alias("started_at"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("current_stage"))
    return runs.filter(F.col("run_id") != run_id).select("run_id", "started_at", "status", "current_stage").unionByName(new)


def update(runs: DataFrame, run_id: str, status: str, stage: str | None = None) -> DataFrame:
    own = F.col("run_id") == run_id
    return runs.withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("current_stage", F.when(own, F.lit(stage).cast("string")).otherwise(F.col("current_stage")))


def delete_run(runs: DataFrame, logs: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """runs and logs without one run, or without all of them; its log lines go too."""
    if run_id is None:
        return runs.limit(0), logs.limit(0)
    return runs.filter(F.col("run_id") != run_id), logs.filter(F.col("run_id") != run_id)


def logs_of(logs: DataFrame, run_id, limit: int = 1000) -> DataFrame:
    """A run's lines in order, the first `limit`."""
    return logs.filter(F.col("run_id") == run_id).orderBy("timestamp", "id").limit(limit)
