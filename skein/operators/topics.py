"""Topic lookup, cluster overviews, and what the cluster pages show."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cluster_color
from ..functions.vectors import top_k
from .ingest import lookup as by_title


@dataclass
class Topic:
    """What a lookup tells of an article."""

    title: str
    cluster_id: int
    similar: list[str]
    keywords: list[str] | None
    explanation: dict = field(default_factory=dict)


def lookup(corpus: DataFrame, summaries: DataFrame, title: str, n: int = 10) -> Topic:
    """The cluster, similar articles and summary of a title, whatever its case; KeyError if it isn't there.

    Of the n nearest rows (Euclidean, vectors as they are) the article itself is left out. corpus: doc_idx, title,
    cluster_id, embedding; summaries: cluster_id, size, keywords, top_articles.
    """
    own = by_title(corpus, title).first()
    if own is None:
        raise KeyError(f"{title!r} isn't in the corpus")
    near = top_k(corpus.select("doc_idx", "title", "embedding"), own["embedding"], n, "euclidean")
    similar = [r["title"] for r in near.filter(F.col("doc_idx") != own["doc_idx"]).orderBy("dist", "doc_idx").collect()]  # n rows at most
    s = summaries.filter(F.col("cluster_id") == own["cluster_id"]).first()
    told = {"cluster_size": s["size"], "top_articles": list(s["top_articles"] or [])} if s else {}
    return Topic(own["title"], own["cluster_id"], similar, list(s["keywords"] or []) if s else None, told)


def summary(summaries: DataFrame, cluster_id: int) -> dict:
    """A cluster's summary; KeyError if there is none."""
    row = summaries.filter(F.col("cluster_id") == cluster_id).first()
    if row is None:
        raise KeyError(f"there is no cluster {cluster_id}")
    return {"cluster_id": row["cluster_id"], "size": row["size"], "keywords": list(row["keywords"] or []), "top_articles": list(row["top_articles"] or [])}


def overview(summaries: DataFrame) -> DataFrame:
    return summaries.select(*[c for c in ("cluster_id", "size", "keywords") if c in summaries.columns])


def cluster_name() -> Column:
    """The first top article, or "Cluster" and the id."""
    return F.coalesce(F.get("top_articles", F.lit(0)), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))


def cluster_table(summaries: DataFrame, query: str = "", sort: str = "size", descending: bool = True) -> DataFrame:
    """summaries with name and position (from 1): those whose name or keywords hold the query, whatever its case, sorted by
    name, size or id; ties by id."""
    named = summaries.withColumn("name", cluster_name())
    if query.strip():
        q = query.lower()
        named = named.filter(F.lower("name").contains(q) | F.lower(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).contains(q))
    key = {"name": F.lower("name"), "size": F.col("size"), "id": F.col("cluster_id")}[sort]
    order = [key.desc() if descending else key.asc(), F.col("cluster_id").asc()]
    return named.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # a row for each cluster


def shown(summaries: DataFrame, keywords: int = 10, articles: int = 10) -> DataFrame:
    """summaries with their lists cut to what a page shows."""
    return summaries.withColumn("keywords", F.slice("keywords", 1, keywords)).withColumn("top_articles", F.slice("top_articles", 1, articles))


def totals(summaries: DataFrame) -> DataFrame:
    """One row: clusters, articles in them, and mean keywords of a cluster."""
    words = F.coalesce(F.size("keywords"), F.lit(0))
    return summaries.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("articles"), F.round(F.avg(words), 6).alias("avg_keywords"))


def legend(points: DataFrame) -> DataFrame:
    """cluster_id, count and color of the clusters on a map."""
    return points.groupBy("cluster_id").agg(F.count("*").alias("count")).withColumn("color", cluster_color(F.col("cluster_id")))


def map_points(vectors: DataFrame, assignments: DataFrame, summaries: DataFrame | None = None, most: int = 5) -> DataFrame:
    """title and cluster_id (-1 without an assignment), the other columns of vectors, and the cluster's first keywords."""
    out = vectors.drop("cluster_id").join(assignments.select("title", "cluster_id"), "title", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    if summaries is None:
        return out
    words = summaries.select("cluster_id", F.slice("keywords", 1, most).alias("keywords"))
    return out.join(words, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def flagged(points: DataFrame, query: str = "", selected: int | None = None) -> DataFrame:
    """points with matches, selected, opacity and size, as the map draws them; a blank query matches all, no selection
    selects all."""
    q = query.lower().strip()
    match = F.lower("title").contains(q) if q else F.lit(True)
    chosen = F.lit(True) if selected is None else F.col("cluster_id") == selected
    size = F.when(match & chosen, 100).when(match, 80).when(chosen, 60).otherwise(40)
    return points.withColumns({"matches": match, "selected": chosen, "opacity": F.when(chosen, 1.0).otherwise(0.3), "size": size})


def visible_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(F.col("matches") & F.col("selected")).alias("visible"), F.count("*").alias("points"))
