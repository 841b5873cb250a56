"""Ingestion: record normalization, filters, first-seen dedup under a budget, configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, normalize_text, word_count


def check_config(queries: list[str], per_query: int, most: int) -> list[str]:
    """Warnings; raises ValueError outside the limits: 3 to 6 queries, 1 to 70 each, 50 to 1000 in all."""
    queries = [q.strip() for q in queries if q and q.strip()]
    if not 3 <= len(queries) <= 6:
        raise ValueError("between 3 and 6 queries are needed")
    if not 1 <= per_query <= 70:
        raise ValueError("per_query must be 1 to 70")
    if not 50 <= most <= 1000:
        raise ValueError("the number of articles must be 50 to 1000")
    return [f"{len(queries) * per_query} results may be found, {most} are kept"] if len(queries) * per_query > most else []


def _names(df: DataFrame, column: str) -> Column:
    """A column of names as an array of strings: of an array of structs the name fields, of an array its items, of a single
    value that one; nulls go."""
    kind = dict(df.dtypes).get(column)
    if kind is None:
        return F.array().cast("array<string>")
    if not kind.startswith("array"):
        return F.when(F.col(column).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(column).cast("string")))
    item = (lambda x: x["name"].cast("string")) if kind.startswith("array<struct") else (lambda x: x.cast("string"))
    return F.filter(F.transform(F.coalesce(F.col(column), F.array().cast(kind)), item), lambda x: x.isNotNull())


def normalize_record(raw: DataFrame) -> DataFrame:
    """title (or else name), text (null: empty), categories and links as arrays of names; other columns stay in front."""
    some = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "name") if c in raw.columns]
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in raw.columns else F.lit("")
    own = [c for c in raw.columns if c not in ("title", "name", "text", "categories", "links")]
    return raw.select(*own, (F.coalesce(*some) if some else F.lit(None).cast("string")).alias("title"), text.alias("text"), _names(raw, "categories").alias("categories"), _names(raw, "links").alias("links"))


def text_for_embedding(docs: DataFrame) -> Column:
    """The normalized text if there is such a column, else the cleaned one; null is empty."""
    return F.coalesce(F.col("nltk_cleaned_text" if "nltk_cleaned_text" in docs.columns else "cleaned_text"), F.lit(""))


def text_for_search(docs: DataFrame) -> Column:
    """The cleaned text, else the raw one."""
    have = [F.col(c) for c in ("cleaned_text", "raw_text") if c in docs.columns]
    return F.coalesce(*have, F.lit(""))


def positional(left: DataFrame, right: DataFrame, position: str = "doc_idx") -> DataFrame:
    """Rows joined by their explicit position; ValueError unless both have the same number of rows."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows don't align with {m}")
    return left.join(right, position)


def check_columns(df: DataFrame, *needed: str) -> DataFrame:
    """df, or ValueError if it lacks a column."""
    if lacking := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns {lacking} are missing")
    return df


def not_stub(docs: DataFrame, text: str = "raw_text", least: int = 200) -> DataFrame:
    return docs.filter(word_count(F.col(text)) >= least)


def complete(docs: DataFrame, title: str = "title", text: str = "raw_text") -> DataFrame:
    return docs.filter((F.length(title) > 0) & (F.length(text) > 0))


def first_seen_budget(found: DataFrame, budget: int | None = None) -> DataFrame:
    """(query, pos, title): each title's first sight in query order, the first `budget` of them."""
    best = found.groupBy("title").agg(F.min(F.struct("query", "pos")).alias("r")).select("title", "r.query", "r.pos")
    return best.orderBy("query", "pos", "title").limit(budget) if budget else best


def cleaned(docs: DataFrame) -> DataFrame:
    """The six columns of a cleaned article."""
    c = clean_text(F.col("raw_text"))
    return docs.select("title", "raw_text", c.alias("cleaned_text"), normalize_text(c).alias("nltk_cleaned_text"), "categories", F.coalesce(F.col("links"), F.array().cast("array<string>")).alias("links") if "links" in docs.columns else F.array().cast("array<string>").alias("links"))


def corpus_stats(docs: DataFrame, text: str = "raw_text", stub: int = 200) -> DataFrame:
    """One row: articles, total and mean words, stubs; and total and mean links if docs has them."""
    w = word_count(F.col(text))
    links = [F.sum(n := F.size(F.coalesce("links", F.array().cast("array<string>")))).cast("long").alias("total_links"), F.round(F.avg(n), 6).alias("avg_links")] if "links" in docs.columns else []
    return docs.agg(F.count("*").alias("articles"), F.sum(w).cast("long").alias("total_words"), F.round(F.avg(w), 6).alias("avg_words"), F.count_if(w < stub).alias("stubs"), *links)


def last_wins(df: DataFrame) -> DataFrame:
    """For each title, whatever its case, the row with the largest doc_idx."""
    rank = F.row_number().over(Window.partitionBy(F.lower("title")).orderBy(F.desc("doc_idx")))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def lookup(df: DataFrame, title: str) -> DataFrame:
    return last_wins(df.filter(F.lower("title") == title.strip().lower()))
