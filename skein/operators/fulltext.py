"""Full-text search over a positional inverted index: English stop words and stems, all words must occur, and a rank from
how often the words occur and how near one another.

The index has a row for each term and document: the places (counted over all words, stop words too, through the fields in
order) and each place's weight. It is made without a shuffle, document by document, and stored in ranges of terms, so that
a query reads the rows of its own terms; a very common term lies in several files.

Rank, for weights w (0.1 each by default):

* of one term: (the sum of w_j / j^2 over its places j = 1, 2, .., with the largest weight counted in full) / 1.6449, which
  is pi^2 / 6;
* of several: 1 - the product of 1 - sqrt(w_a w_b c) over all pairs of places of two different terms, where
  c = 1 / (1.005 + 0.05 exp(d / 1.5 - 2)) for d places between them, and 1e-30 beyond 100.

As in the search that it stands for, places beyond LAST count as LAST, and a term has at most MOST places in a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import porter

LAST, MOST = 16383, 255
#: The English stop words of the dictionary.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now""".split()
_WORD = re.compile(r"[^\W_]+")


def plural(word: str) -> str:
    """A word without its plural ending (D. Harman, How effective is suffixing?, 1991): the first rule that applies."""
    if word.endswith("ies"):
        return word if word.endswith(("eies", "aies")) else word[:-3] + "y"
    if word.endswith("es"):
        return word if word.endswith(("aes", "ees", "oes")) else word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith(("us", "ss")) else word


STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter, "plural": plural, "none": str}


def terms(text: str, stem: Callable[[str], str], stop: frozenset[str]) -> Iterator[tuple[int, str | None]]:
    """Place (from 1) and term of each word; None for a stop word."""
    for i, word in enumerate(_WORD.findall(text.lower()), 1):
        yield i, None if word in stop else stem(word)


def build(docs: DataFrame, fields: tuple[str, ...] = ("title", "raw_text"), weights: tuple[float, ...] = (0.1, 0.1), stemmer: str = "porter", stop: list[str] = STOP, last: int = LAST, most: int = MOST, only: list[str] | None = None) -> DataFrame:
    """term, doc_idx, places and weights (of some terms only, if these are given). A null field is empty."""
    none, some = frozenset(stop), None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = lru_cache(1 << 16)(STEMMERS[stemmer])
        for b in batches:
            ids, out = b.column(0).to_pylist(), ([], [], [], [])
            for row in range(b.num_rows):
                at, found = 0, {}
                for f, w in enumerate(weights, 1):
                    i = 0
                    for i, term in terms(b.column(f)[row].as_py() or "", stem, none):
                        if term is not None and (some is None or term in some) and len(hits := found.setdefault(term, [])) < most and (not hits or hits[-1][0] < last):
                            hits.append((min(at + i, last), w))
                    at += i
                for term, hits in found.items():
                    for column, value in zip(out, (term, ids[row], [p for p, _ in hits], [w for _, w in hits])):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = ([], [], [], [])
            yield _batch(out)

    return docs.select(F.col("doc_idx").cast("long"), *[F.col(f).cast("string") for f in fields]).mapInArrow(run, "term string, doc_idx long, places array<int>, weights array<double>")


def _batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "doc_idx", "places", "weights"])


def store(index: DataFrame, path: str, stemmer: str = "porter", stop: list[str] = STOP) -> None:
    """Writes the index, its stemmer and stop words; a term's rows lie together, in several files if they are many."""
    index.repartitionByRange("term", "doc_idx").sortWithinPartitions("term", "doc_idx").write.parquet(f"{path}/postings")
    index.sparkSession.createDataFrame([(stemmer, list(stop))], "stemmer string, stop array<string>").coalesce(1).write.parquet(f"{path}/dictionary")


def _single(places: str) -> str:
    """SQL text: the rank of one term by its weights, in order of places."""
    each = f"aggregate(sequence(1, size({places})), cast(0 as double), (s, j) -> s + {places}[j - 1] / (j * j))"
    first = f"array_position({places}, array_max({places}))"
    return f"(array_max({places}) + {each} - array_max({places}) / ({first} * {first})) / 1.64493406685"


#: SQL text: the logarithm of what all pairs of places of terms i < k leave of 1.
_NEAR = """aggregate(sequence(0, size(hits) - 2), cast(0 as double), (s, i) -> s + aggregate(sequence(i + 1, size(hits) - 1), cast(0 as double), (t, k) -> t +
  aggregate(arrays_zip(hits[i].places, hits[i].weights), cast(0 as double), (u, a) -> u + aggregate(arrays_zip(hits[k].places, hits[k].weights), cast(0 as double), (v, b) -> v +
    case when a.places = b.places then 0 else ln(1 - sqrt(a.weights * b.weights * case when abs(a.places - b.places) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(a.places - b.places) / 1.5D - 2)) end)) end))))"""


def ranked(index: DataFrame, query_terms: list[str]) -> DataFrame:
    """doc_idx and rank of the documents that have every term."""
    wanted = sorted(set(query_terms))
    if not wanted:
        return index.select("doc_idx", F.lit(0.0).alias("rank")).limit(0)
    rows = index.filter(F.col("term").isin(wanted)).groupBy("doc_idx").agg(F.sort_array(F.collect_list(F.struct("term", "places", "weights"))).alias("hits")).filter(F.size("hits") == len(wanted))
    rank = F.expr(_single("hits[0].weights")) if len(wanted) == 1 else F.greatest(F.lit(1e-20), 1 - F.exp(F.expr(_NEAR)))
    return rows.select("doc_idx", rank.alias("rank"))


def query_terms(query: str, stemmer: str = "porter", stop: list[str] = STOP) -> list[str]:
    """The different terms of a query; stop words are left out."""
    found = (t for _, t in terms(query, STEMMERS[stemmer], frozenset(stop)))
    return list(dict.fromkeys(t for t in found if t is not None))


def _best(hits: DataFrame, k: int, names: DataFrame | None) -> DataFrame:
    top = hits.withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "doc_idx").limit(k)
    return top if names is None else top.join(names, "doc_idx").orderBy(F.desc("rank"), "doc_idx")


def search(docs: DataFrame, query: str, k: int = 10, stemmer: str = "porter", **options) -> DataFrame:
    """The k best documents (doc_idx, rank, title) of a corpus without an index; ties by doc_idx."""
    wanted = query_terms(query, stemmer, options.get("stop", STOP))
    return _best(ranked(build(docs, stemmer=stemmer, only=wanted, **options), wanted), k, docs.select("doc_idx", "title"))


class Stored:
    """A stored index: queries read the rows of their own terms."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.postings = spark.read.parquet(f"{path}/postings")
        told = spark.read.parquet(f"{path}/dictionary").first()
        self.stemmer, self.stop = told["stemmer"], told["stop"]

    def search(self, query: str, k: int = 10, names: DataFrame | None = None) -> DataFrame:
        """doc_idx and rank of the k best documents, and the columns of names (by doc_idx); ties by doc_idx."""
        return _best(ranked(self.postings, query_terms(query, self.stemmer, self.stop)), k, names)


def matches(query: str, text: Column, stemmer: str = "porter", stop: list[str] = STOP) -> Column:
    """Whether a text has every term of the query (and the query has any), for filters on a column."""
    wanted, none = set(query_terms(query, stemmer, stop)), frozenset(stop)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        stem = lru_cache(1 << 16)(STEMMERS[stemmer])
        return pa.array([bool(wanted) and wanted <= {t for _, t in terms(x or "", stem, none)} for x in texts.to_pylist()], pa.bool_())

    return found(text)
