"""Sources behind a web API: article search, single articles and batches, each partition with its own rate limiter.

A transport answers a request: a function from a parameter dict to a decoded JSON value, named as "module:function" so that
executors import it themselves. `http` asks a real service; `folder` reads stored answers from any file system that
pyarrow knows, which is how tests and offline runs work.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_rate_limit_text
from ..operators.entities import named
from . import TokenBucket, backoff

Transport = Callable[[dict], object]
ARTICLE = "title string, text string, revisions long, categories array<string>, links array<string>, error string"


class RateLimited(Exception):
    """The service asked for fewer requests."""


def http(url: str, timeout: float = 5.0, agent: str = "skein/1.0") -> Transport:
    """Asks a service; its refusal for too many requests is RateLimited."""

    def fetch(parameters: dict) -> object:
        ask = urllib.request.Request(f"{url}?{urllib.parse.urlencode(parameters)}", headers={"User-Agent": agent})
        try:
            with urllib.request.urlopen(ask, timeout=timeout) as answer:
                return json.load(answer)
        except OSError as e:
            if is_rate_limit_text(str(e)):
                raise RateLimited(str(e)) from e
            raise

    return fetch


def folder(uri: str) -> Transport:
    """Answers from <uri>/<kind>/<quoted key>.json; a file that isn't there is an empty answer."""

    def fetch(parameters: dict) -> object:
        fs, root = pa.fs.FileSystem.from_uri(uri)
        path = f"{root}/{parameters['kind']}/{urllib.parse.quote(parameters['key'], safe='')}.json"
        if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    return fetch


def transport(spec: str) -> Transport:
    """http(s)://... asks that service, module:function is that function, anything else a folder of answers."""
    if spec.startswith(("http://", "https://")):
        return http(spec)
    if "://" not in spec and ":" in spec:
        return named(spec)
    return folder(spec if "://" in spec else f"file://{spec}")


def patient(fetch: Transport, rate: float, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Transport:
    """fetch within a rate of requests a second, asked again after growing pauses when the service says it is too much."""
    bucket = TokenBucket(rate)

    def ask(parameters: dict) -> object:
        for attempt in range(retries + 1):
            sleep(bucket.wait())
            try:
                return fetch(parameters)
            except RateLimited:
                if attempt == retries:
                    raise
                sleep(backoff(attempt))

    return ask


class SearchSource(DataSource):
    """query, position, title, snippet of searches, a partition for each query.

    Options: transport, queries (a JSON list, or separated by commas), limit (10), rate (50 requests a second).
    """

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "query string, position long, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options) -> None:
        q = options["queries"]
        self.queries = json.loads(q) if q.lstrip().startswith("[") else q.split(",")
        self.spec, self.limit, self.rate = options["transport"], int(options.get("limit", "10")), float(options.get("rate", "50"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ask = patient(transport(self.spec), self.rate / max(1, len(self.queries)))
        hits = ask({"kind": "search", "key": partition.value, "limit": self.limit}) or []
        for n, hit in enumerate(hits[: self.limit]):
            yield partition.value, n, hit.get("title"), hit.get("snippet") or ""


def record(found: dict, links: bool, categories: bool, max_links: int) -> tuple:
    """title, text, revisions, categories and links of an answer."""
    names = lambda key: [x["name"] if isinstance(x, dict) else str(x) for x in found.get(key) or []]
    return found.get("title"), found.get("text") or "", found.get("revisions"), names("categories") if categories else [], names("links")[:max_links] if links else []


def fetch_articles(titles: DataFrame, spec: str, links: bool = False, categories: bool = False, max_links: int = 50, rate: float = 50.0, title_col: str = "title") -> DataFrame:
    """The titles (as `asked`) with the article's title, text, revisions, categories and links; all null if there is no such
    page, and with the error's words if the request failed. One partition asks `rate` times a second at most, divided by
    the number of partitions."""
    parts = max(1, titles.select(title_col).rdd.getNumPartitions()) if rate else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = patient(transport(spec), rate / parts)
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                try:
                    found = ask({"kind": "article", "key": t}) if t else None
                    rows.append((*record(found, links, categories, max_links), None) if found else (None,) * 6)
                except Exception as e:
                    rows.append((None,) * 5 + (f"{type(e).__name__}: {e}",))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["asked", "title", "text", "revisions", "categories", "links", "error"])

    return titles.select(F.col(title_col).cast("string").alias("asked")).mapInArrow(run, f"asked string, {ARTICLE}")


def fetch_batch(titles: DataFrame, spec: str, **options) -> DataFrame:
    """As fetch_articles, each distinct title once; rows whose request failed are null, their errors left out."""
    return fetch_articles(titles.distinct(), spec, **options).drop("error")
