"""Entity linking through a cache of titles, with a lookup for what the cache lacks."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_url

Lookup = Callable[[str], str | None]


def search_entities(fetch: Callable[[dict], dict], delay: float = 0.0) -> Lookup:
    """A lookup that asks an entity search (its first hit's id) through fetch(parameters); failures are no entity."""
    import time

    def find(title: str) -> str | None:
        time.sleep(delay)
        try:
            found = fetch({"action": "wbsearchentities", "search": title, "language": "en", "format": "json", "limit": 1}).get("search") or [{}]
            return found[0].get("id")
        except Exception:
            return None

    return find


def named(lookup: str) -> Lookup:
    """The function that "module:name" names, so that executors import it themselves."""
    module, _, name = lookup.partition(":")
    return getattr(importlib.import_module(module), name)


def link(titles: DataFrame, cache: DataFrame, lookup: Lookup | None = None) -> DataFrame:
    """titles with qid, state (found, absent: known to have none, miss: not known) and url.

    The cache (title in lower case, qid or null) answers first; what it lacks goes to the lookup, once for each distinct
    title, in Arrow batches, and becomes found or absent.
    """
    # a null key meets nothing and is never looked up
    known = latest(cache).withColumnRenamed("title", "__key").withColumn("__hit", F.lit(True))
    out = titles.withColumn("__low", F.lower("title")).join(known, F.col("__low") == F.col("__key"), "left")
    if lookup is not None:
        new = found(out.filter("__hit is null and title is not null").groupBy("__low").agg(F.min("title").alias("title")), lookup)
        out = out.join(new, "__low", "left").withColumn("qid", F.coalesce("qid", "__new")).withColumn("__hit", F.coalesce("__hit", "__asked"))
    state = F.when(F.col("__hit").isNull(), "miss").when(F.col("qid").isNull(), "absent").otherwise("found")
    return out.select(*titles.columns, "qid", state.alias("state"), entity_url(F.col("qid")).alias("url"))


def found(titles: DataFrame, lookup: Lookup) -> DataFrame:
    """__low, __new (the id or null) and __asked of titles (__low, title)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lookup(t) for t in b.column(1).to_pylist()], pa.string()), pa.array([True] * b.num_rows)], ["__low", "__new", "__asked"])

    return titles.select("__low", "title").mapInArrow(run, "__low string, __new string, __asked boolean")


def latest(cache: DataFrame) -> DataFrame:
    """title and qid of a cache, the last entry (by `at`, if there is such a column) of each title."""
    if "at" not in cache.columns:
        return cache.groupBy("title").agg(F.max("qid").alias("qid"))
    return cache.groupBy("title").agg(F.max(F.struct("at", "qid")).alias("r")).select("title", F.col("r.qid").alias("qid"))


def merged(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A cache with new entries in place of old ones of the same title; titles are in lower case."""
    new = new.select(F.lower("title").alias("title"), "qid").dropDuplicates(["title"])
    return cache.select("title", "qid").join(new.select("title"), "title", "left_anti").unionByName(new)


def linked_batch(titles: DataFrame, cache: DataFrame, lookup: Lookup) -> tuple[DataFrame, DataFrame]:
    """The linked titles, and the cache with all that was asked, found or not."""
    out = link(titles, cache, lookup)
    return out, merged(cache, out.filter("state <> 'miss' and title is not null").select("title", "qid"))
