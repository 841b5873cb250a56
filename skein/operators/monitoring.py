"""Stability of labelings, drift between a baseline and the current run, request metrics."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import sampled


def stability(base: DataFrame, now: DataFrame) -> DataFrame:
    """ari, nmi, same-label ratio and counts of two labelings (title, label); all zero if they share no title."""
    table = base.select("title", F.col("label").alias("b")).join(now.select("title", F.col("label").alias("c")), "title").groupBy("b", "c").agg(F.count("*").alias("n"))
    rows, cols = (table.groupBy(k).agg(F.sum("n").alias("m")) for k in "bc")
    choose = lambda n: F.col(n) * (F.col(n) - 1) / 2
    both = table.agg(F.sum(choose("n")).alias("index"), F.sum("n").alias("total"), F.sum(F.when(F.col("b").cast("string") == F.col("c").cast("string"), F.col("n")).otherwise(0)).alias("same"))
    sides = rows.agg(F.sum(choose("m")).alias("ra"), F.sum(F.col("m") * F.log("m")).alias("ha")).crossJoin(cols.agg(F.sum(choose("m")).alias("rb"), F.sum(F.col("m") * F.log("m")).alias("hb")))
    joint = table.agg(F.sum(F.col("n") * F.log("n")).alias("hab"))
    x = both.crossJoin(sides).crossJoin(joint)
    total, pairs = F.col("total"), F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("ra") * F.col("rb") / pairs
    top = (F.col("ra") + F.col("rb")) / 2 - expected
    ha, hb = F.log(total) - F.col("ha") / total, F.log(total) - F.col("hb") / total
    mutual = ha + hb - (F.log(total) - F.col("hab") / total)
    return x.select(
        F.round(F.coalesce(F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("index") - expected) / top), F.lit(0.0)), 6).alias("ari"),
        F.round(F.coalesce(F.when(ha + hb < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), mutual) / ((ha + hb) / 2)), F.lit(0.0)), 6).alias("nmi"),
        F.round(F.coalesce(F.col("same") / total, F.lit(0.0)), 6).alias("same_ratio"),
        F.coalesce(total, F.lit(0)).alias("overlap"),
    )


def evolution(base: DataFrame, now: DataFrame) -> DataFrame:
    """cluster_id, state (stable, birth, death), base_size, now_size, change_pct of two labelings."""
    b, c = (x.groupBy("label").agg(F.count("*").alias(n)) for x, n in ((base, "base_size"), (now, "now_size")))
    both = b.join(c, "label", "full")
    state = F.when(F.col("base_size").isNull(), "birth").when(F.col("now_size").isNull(), "death").otherwise("stable")
    change = F.when(state == "stable", F.round((F.col("now_size") - F.col("base_size")) / F.col("base_size") * 100, 6))
    return both.select(F.col("label").alias("cluster_id"), state.alias("state"), F.coalesce("base_size", F.lit(0)).alias("base_size"), F.coalesce("now_size", F.lit(0)).alias("now_size"), change.alias("change_pct"))


def evolution_totals(base: DataFrame, now: DataFrame) -> DataFrame:
    """One row of two summaries (cluster_id, size): births, deaths and stable clusters, their lists, and mean and population
    deviation of the stable ones' change in percent (those with a baseline size)."""
    both = base.select("cluster_id", F.col("size").alias("b")).join(now.select("cluster_id", F.col("size").alias("c")), "cluster_id", "full")
    birth, death = F.col("b").isNull(), F.col("c").isNull()
    change = F.when(~birth & ~death & (F.col("b") > 0), (F.col("c") - F.col("b")) / F.col("b") * 100)

    def ids(which: Column, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(which, F.col("cluster_id")))).alias(name)

    return both.agg(
        F.count_if(birth).alias("birth_count"),
        F.count_if(death).alias("death_count"),
        F.count_if(~birth & ~death).alias("stable_count"),
        ids(birth, "birth_clusters"),
        ids(death, "death_clusters"),
        ids(~birth & ~death, "stable_clusters"),
        F.round(F.coalesce(F.avg(change), F.lit(0.0)), 6).alias("avg_size_change_pct"),
        F.round(F.coalesce(F.stddev_pop(change), F.lit(0.0)), 6).alias("std_size_change_pct"),
    )


def moment_drift(base: DataFrame, now: DataFrame) -> DataFrame:
    """Length of the differences of the per-dimension means and standard deviations."""

    def moments(v: DataFrame, x: str) -> DataFrame:
        return v.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias(f"m{x}"), F.stddev_pop("x").alias(f"s{x}"))

    d = moments(base, "a").join(moments(now, "b"), "pos")
    return d.agg(F.round(F.sqrt(F.sum(F.pow(F.col("ma") - F.col("mb"), 2))), 6).alias("mean_drift"), F.round(F.sqrt(F.sum(F.pow(F.col("sa") - F.col("sb"), 2))), 6).alias("std_drift"))


def vocabulary_drift(base: DataFrame, now: DataFrame, column: str = "raw_text") -> DataFrame:
    a, b = (x.select(F.explode(F.filter(F.split(F.lower(F.col(column)), "[ \\t\\n\\r\\f]+"), lambda t: t != "")).alias("t")).distinct() for x in (base, now))
    one = F.lit(1)
    c = a.withColumn("a", one).join(b.withColumn("b", one), "t", "full").agg(F.count("a").alias("base_vocab"), F.count("b").alias("current_vocab"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("total"))
    j = F.coalesce(F.try_divide("shared", "total"), F.lit(0.0))
    return c.select("base_vocab", "current_vocab", F.round(j, 6).alias("vocab_jaccard"), F.round(1 - j, 6).alias("vocab_drift"))


def ks_statistic(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    return ks_distance(base, now, column).withColumn("ks", F.round("ks", 6))


def running(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """df with <name>_to for each of sums: its running sum in the order of `order` (whose values are distinct), within `by`.

    Ranges of values are summed side by side and shifted by the sums of the ranges before, so no window holds a whole group.
    """
    by = by or []
    part = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, order).withColumn("__p", F.spark_partition_id())
    totals = part.groupBy(*by, "__p").agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "__p", *[F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    here = Window.partitionBy(*by, "__p").orderBy(order)
    return part.join(shift, [*by, "__p"]).withColumns({f"{c}_to": F.col(f"{c}_before") + F.sum(c).over(here) for c in sums}).drop("__p", *[f"{c}_before" for c in sums])


def ks_distance(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """Largest distance of the two empirical distributions, with both sizes.

    Equal values are counted first; the running sums go over the distinct values."""
    both = base.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(now.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    seen = running(steps, "x", ["a", "b"])
    d = seen.crossJoin(F.broadcast(n)).select(F.abs(F.try_divide(F.col("a_to"), F.col("na")) - F.try_divide(F.col("b_to"), F.col("nb"))).alias("d"), "na", "nb")
    return d.agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("ks"), F.coalesce(F.max("na"), F.lit(0)).cast("long").alias("n_base"), F.coalesce(F.max("nb"), F.lit(0)).cast("long").alias("n_current"))


def ks_pvalue(d: float, n: int, m: int, exact_below: int = 10_000) -> float:
    """The two-sided p-value of a two-sample Kolmogorov-Smirnov statistic: exact for samples of up to exact_below each, by
    counting the lattice paths that stay within the distance; the asymptotic series above."""
    if not n or not m or d <= 0:
        return 1.0
    if max(n, m) <= exact_below:
        g = math.gcd(n, m)
        h = round(d * n * m / g)  # the statistic is a multiple of g / (n m)
        j = np.arange(m + 1)
        paths, scale = np.where(j * (n // g) < h, 1.0, 0.0), 0.0
        for i in range(1, n + 1):  # paths to (i, j) come from (i - 1, j) or (i, j - 1)
            low, high = np.searchsorted(j * (n // g), [i * (m // g) - h + 1, i * (m // g) + h])
            row = np.zeros(m + 1)
            row[low:high] = np.cumsum(paths[low:high])
            if not (top := row.max()):
                return 1.0
            paths, scale = row / top, scale + math.log(top)
        if not paths[m]:
            return 1.0
        inside = math.exp(math.log(paths[m]) + scale - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)))
        if 1 - inside > 1e-8:  # smaller ones are lost in the difference
            return min(1.0, max(0.0, 1 - inside))
    en = math.sqrt(n * m / (n + m))
    t = (en + 0.12 + 0.11 / en) * d
    return 1.0 if t < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))


def ks_test(base: DataFrame, now: DataFrame, column: str = "x") -> tuple[float, float]:
    """Statistic and p-value of a column of two frames; (0, 1) if either is empty."""
    r = ks_distance(base.filter(F.col(column).isNotNull()), now.filter(F.col(column).isNotNull()), column).first()
    return (float(r["ks"]), ks_pvalue(r["ks"], r["n_base"], r["n_current"])) if r["n_base"] and r["n_current"] else (0.0, 1.0)


def embedding_drift(base: DataFrame, now: DataFrame, sample: int | None = 5000, significant: float = 0.05) -> dict[str, float | bool]:
    """Drift of two frames of vectors (doc_idx, embedding): moments, and a KS test on the baseline's first principal
    component, on to which both are projected. Over `sample` baseline rows both are sampled."""
    if sample and base.limit(sample + 1).count() > sample:
        base, now = sampled(base, sample), sampled(now, sample)
    drift = moment_drift(base, now).first()
    f = [x.select(array_to_vector("embedding").alias("features")) for x in (base, now)]
    try:
        if base.isEmpty() or now.isEmpty():
            raise IllegalArgumentException("nothing to project")
        # centering moves both sides alike, so the statistic is that of centered data
        model = PCA(k=1, inputCol="features", outputCol="p").fit(f[0])
        statistic, p = ks_test(*[model.transform(x).select(vector_to_array("p")[0].alias("x")) for x in f])
    except IllegalArgumentException:  # without rows there is no component
        statistic, p = 0.0, 1.0
    return {"mean_drift": drift["mean_drift"] or 0.0, "std_drift": drift["std_drift"] or 0.0, "ks_statistic": statistic, "ks_pvalue": p, "drift_detected": p < significant}


def text_drift_row(base: DataFrame, now: DataFrame, column: str = "cleaned_text") -> DataFrame:
    """One row: drift of the mean length, KS statistic of lengths with both counts, and vocabulary Jaccard, drift and sizes."""
    lengths = [x.select(F.length(column).alias("x")).filter("x is not null") for x in (base, now)]
    mean = [x.agg(F.avg("x").alias(n)) for x, n in zip(lengths, "bc")]
    drift = mean[0].crossJoin(mean[1]).select(F.round(F.coalesce(F.try_divide(F.abs(F.col("c") - F.col("b")), F.col("b")), F.lit(0.0)), 6).alias("avg_length_drift"))
    words = vocabulary_drift(base, now, column).select("vocab_jaccard", "vocab_drift", F.col("base_vocab").alias("baseline_vocab_size"), F.col("current_vocab").alias("current_vocab_size"))
    ks = ks_distance(*lengths, "x").select(F.col("ks").alias("length_ks_statistic"), "n_base", "n_current")
    return drift.crossJoin(ks).crossJoin(words)


def text_drift(base: DataFrame, now: DataFrame, column: str = "cleaned_text") -> dict[str, float]:
    """As text_drift_row, with the p-value. Vocabulary figures are given only if the baseline has words; without a text on
    either side the lengths' figures are left out."""
    if column not in base.columns or column not in now.columns:
        return {}
    r, out = text_drift_row(base, now, column).first(), {}
    if r["n_base"] and r["n_current"]:
        out = {"avg_length_drift": r["avg_length_drift"], "length_ks_statistic": r["length_ks_statistic"], "length_ks_pvalue": ks_pvalue(r["length_ks_statistic"], r["n_base"], r["n_current"])}
    return out | ({c: r[c] for c in ("vocab_jaccard", "vocab_drift", "baseline_vocab_size", "current_vocab_size")} if r["baseline_vocab_size"] else {})


def cluster_drift_row(base: DataFrame, now: DataFrame) -> DataFrame:
    """One row of two assignments (title, cluster_id): cluster_drift, assignment_overlap, shared titles, and the KS statistic
    of the aligned cluster sizes with their number."""
    both = base.select("title", F.col("cluster_id").alias("b")).join(now.select("title", F.col("cluster_id").alias("c")), "title")
    same = both.agg(F.coalesce(F.avg((F.col("b") == F.col("c")).cast("int")), F.lit(0.0)).alias("o"), F.count("*").alias("shared"))
    s = size_drift(*(x.select(F.col("cluster_id").alias("label")) for x in (base, now)))
    ks = ks_distance(s.select(F.col("base_size").alias("x")), s.select(F.col("now_size").alias("x")), "x")
    return same.crossJoin(ks).select(F.round(1 - F.col("o"), 6).alias("cluster_drift"), F.round("o", 6).alias("assignment_overlap"), "shared", F.col("ks").alias("cluster_size_ks_statistic"), F.col("n_base").alias("clusters"))


def cluster_drift(base: DataFrame, now: DataFrame) -> dict[str, float]:
    """As cluster_drift_row, with the p-value; (1, 0) alone if no title is shared."""
    r = cluster_drift_row(base, now).first()
    out = {"cluster_drift": r["cluster_drift"], "assignment_overlap": r["assignment_overlap"]}
    if not r["shared"]:
        return out
    return out | {"cluster_size_ks_statistic": r["cluster_size_ks_statistic"], "cluster_size_ks_pvalue": ks_pvalue(r["cluster_size_ks_statistic"], r["clusters"], r["clusters"])}


def drift_from_tables(base: dict[str, DataFrame], now: dict[str, DataFrame]) -> dict[str, float | bool]:
    """All drift figures of the tables that both sides have (embeddings, articles, assignments), prefixed embedding_, text_
    and cluster_."""
    out: dict[str, float | bool] = {}
    for name, prefix, f in (("embeddings", "embedding_", embedding_drift), ("articles", "text_", text_drift), ("assignments", "cluster_", cluster_drift)):
        if name in base and name in now:
            try:
                out |= {prefix + k: v for k, v in f(base[name], now[name]).items()}
            except Exception as e:  # one table that can't be told leaves the others' figures
                logging.getLogger(__name__).warning("the drift of %s can't be told: %s", name, e)
    return out


def drift_metrics(base: dict[str, DataFrame], now: dict[str, DataFrame], threshold: float = 0.3) -> dict[str, float | bool | str]:
    """drift_from_tables() with the decision; without baseline vectors just that."""
    if "embeddings" not in base:
        return {"drift_detected": False, "reason": "no_baseline"}
    out = drift_from_tables(base, now)
    found = drift_decision({k: out.get(k) for k in ("embedding_ks_pvalue", "text_length_ks_pvalue", "cluster_cluster_size_ks_pvalue")}, threshold)
    return out | {"drift_detected": found, "threshold": threshold}


def numeric(metrics: dict, booleans: bool = False) -> dict[str, float]:
    """The numbers among metrics; booleans count as 0 and 1 or not at all."""
    return {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and (booleans or not isinstance(v, bool))}


def metric_rows(df: DataFrame, booleans: bool = False) -> DataFrame:
    """metric and value of the numeric columns of a frame of one row."""
    some = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") or booleans and t == "boolean"]
    return df.select(*[F.col(c).cast("int").cast("double").alias(c) if dict(df.dtypes)[c] == "boolean" else F.col(c).cast("double").alias(c) for c in some]).unpivot([], some, "metric", "value")


def drift_decision(p_values: dict[str, float | None], threshold: float = 0.3) -> bool:
    """Whether any of the p-values is below the threshold; a missing one is 1."""
    return any((1.0 if p is None else p) < threshold for p in p_values.values())


def size_drift(base: DataFrame, now: DataFrame) -> DataFrame:
    """label, base_size, now_size of two labelings, missing ones 0."""
    b, c = (x.groupBy("label").agg(F.count("*").alias(n)) for x, n in ((base, "base_size"), (now, "now_size")))
    return b.join(c, "label", "full").select("label", F.coalesce("base_size", F.lit(0)).alias("base_size"), F.coalesce("now_size", F.lit(0)).alias("now_size"))


def request_summary(requests: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per endpoint: count, average, percentiles by floor index, error rate.

    Latencies are counted per value first and percentiles read off the running counts, so no endpoint's list is gathered."""
    quantiles = quantiles or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = requests.groupBy("endpoint", "latency_ms").agg(F.count("*").alias("n"))
    total = requests.groupBy("endpoint").agg(F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.round(F.avg((F.col("status_code") >= 400).cast("double")), 6).alias("error_rate"))
    at = running(counts, "latency_ms", ["n"], ["endpoint"]).withColumnRenamed("n_to", "seen").join(total.select("endpoint", "requests"), "endpoint")
    picked = [F.min(F.when(F.col("seen") > F.floor(F.col("requests") * q), F.col("latency_ms"))).alias(name) for name, q in quantiles.items()]
    return total.join(at.groupBy("endpoint").agg(*picked), "endpoint")


def in_window(requests: DataFrame, as_of: Column, seconds: int | None) -> DataFrame:
    return requests.filter(F.col("timestamp") >= as_of - F.make_dt_interval(secs=F.lit(float(seconds)))) if seconds else requests
