"""c-TF-IDF keywords and cluster summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import KEYWORD, is_keyword


def token_counts(docs: DataFrame) -> DataFrame:
    """cluster_id, term, n: terms are exploded, sifted in a filter and counted on the map side before the shuffle."""
    terms = docs.select("cluster_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("raw_text", F.lit(""))), F.lit(KEYWORD), 1)).alias("term"))
    return terms.filter(is_keyword(F.col("term"))).groupBy("cluster_id", "term").agg(F.count("*").alias("n"))


def ctfidf(counts: DataFrame, top: int = 20) -> DataFrame:
    """cluster_id, term, score, rank. A term of every cluster scores 0 and still fills a list that lacks others.

    Counts are shuffled by term once; a cluster's tokens are a sum over all of its terms' counts.
    """
    counts = counts.repartition("term")
    terms = counts.withColumn("cf", F.count("*").over(Window.partitionBy("term")))
    total = counts.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    clusters = total.agg(F.count("*").alias("clusters"))
    scored = terms.join(total, "cluster_id").crossJoin(F.broadcast(clusters))
    scored = scored.withColumn("score", F.round(F.col("n") / F.col("total") * F.log(F.col("clusters") / F.col("cf")), 9))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("cluster_id", "term", "score", "rank")


def ranked_list(rows: DataFrame, column: str, name: str) -> DataFrame:
    """cluster_id and the values of a column in order of their rank."""
    return rows.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", column))), lambda x: x[column]).alias(name))


def summaries(docs: DataFrame, reps: DataFrame, top: int = 20) -> DataFrame:
    """cluster_id, size, keywords, top_articles: the `top` terms, and the titles of reps (cluster_id, title, rank), which are
    the articles nearest to their cluster's center."""
    words = ranked_list(ctfidf(token_counts(docs), top), "term", "keywords")
    best = ranked_list(reps, "title", "top_articles")
    return docs.groupBy("cluster_id").agg(F.count("*").alias("size")).join(words, "cluster_id", "left").join(best, "cluster_id", "left")
