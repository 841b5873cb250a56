"""Language identification by Bayesian evidence fusion.

Evidence of a record: the likelihood of its text under hashed character trigrams of each language, tempered so that a
text can outweigh other evidence without drowning it; the language that its markup declares; its address suffix; and
a prior of its host. The reliability of declarations and suffixes is estimated from the corpus itself: a grouped
aggregation counts how often each goes with each language of the texts. The host's prior is smoothed by its domain's,
and that by the whole corpus's, without the record's own count. All counts cover all records.

Only the fit of the trigrams is bounded: `per_language` labelled documents of each of the `most_languages` languages that
have the most documents, the least by a hash (documented parameters).

Defined results: null, empty and letterless texts have flat likelihoods, so the other evidence decides; a record
without a host, declaration or suffix goes without that evidence, and is dealt by a salt in place of the missing key.
Without labelled documents no language is told. Equal scores go to the first language by code point.
Records with null ids or repeated ones keep their rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, trimmed, utf8, written

BITS = 16
_TAGS = re.compile(rb"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", re.S | re.I)
_LETTERS = bytes(32 if i < 128 and not chr(i).isalpha() else ord(chr(i).lower()) if i < 128 else i for i in range(256))
_GAPS = re.compile(rb" +")
#: Largest weight of a text, in trigrams; longer texts count as much as one of this length.
CAP = 60.0
HOST, DOMAIN, SEEN = 4.0, 16.0, 8.0
SALTS = 1009
#: Range of the hashes that choose the sample, and how many times the sample they leave to choose from.
HASHES, SPARE = 1 << 40, 8


def trigrams(text: bytes, markup: bool) -> np.ndarray:
    if markup:
        text = _TAGS.sub(b" ", text)
    a = np.frombuffer(_GAPS.sub(b" ", b" " + text.translate(_LETTERS) + b" "), np.uint8).astype(np.uint32)
    return (((a[:-2] * np.uint32(31) + a[1:-1]) * np.uint32(37) + a[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 400, most_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities of trigrams (languages x 2**16)."""
    lean(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and id is not null")
    known = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    langs = sorted(r["lang"] for r in known)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    # of each language the ids under a hash that leaves about SPARE times the sample, so that few rows are ordered
    h = F.pmod(F.xxhash64("id"), F.lit(HASHES))
    under = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], int(min(1.0, SPARE * per_language / r["count"]) * HASHES))])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    some = named.select("id", "lang", h.alias("h")).filter(F.col("h") < under[F.col("lang")]).withColumn("nth", nth).filter(F.col("nth") <= per_language)

    number = {x: i for i, x in enumerate(langs)}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                counts[number[lang]] = counts.get(number[lang], 0) + np.bincount(trigrams(text, False), minlength=1 << BITS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at], pa.int64())], ["lang", "g", "n"])

    counts = named.join(F.broadcast(some.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text").mapInArrow(run, "lang int, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    table = np.full((len(langs), 1 << BITS), 0.05)
    found = counts.toArrow()  # numbers, 2**16 rows per language at most
    lang, g, n = (found.column(c).to_numpy() for c in ("lang", "g", "n"))
    table[lang, g] += n
    return langs, np.log(table / table.sum(1, keepdims=True))


def likelihoods(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """records (kind, id, text, host, domain, declared, suffix; markup if kind is page) with ll and p (what the text alone
    says), arrays by language."""
    langs = model[0]
    shipped = records.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)))
            for i, (kind, text) in enumerate(zip(batch.column(0).to_pylist(), utf8(batch.column(2)))):
                g = trigrams(text, kind == "page")
                if len(g) > 1:
                    mean = table[:, g].mean(1, dtype=np.float64)
                    out[i] = (mean - mean.max()) * min(CAP, len(g))
            p = np.exp(out)
            columns = [c for i, c in enumerate(batch.columns) if i != 2]
            yield pa.RecordBatch.from_arrays([*columns, _lists(out), _lists(p / p.sum(1, keepdims=True))], ["kind", "id", "host", "domain", "declared", "suffix", "ll", "p"])

    return records.select("kind", "id", "text", "host", "domain", "declared", "suffix").mapInArrow(run, "kind string, id long, host string, domain string, declared string, suffix string, ll array<double>, p array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def fused(ll: np.ndarray, p: np.ndarray, seen: dict[str, np.ndarray], everywhere: np.ndarray) -> np.ndarray:
    """Scores of records (rows) by language: log-likelihood and the logarithms of prior and evidence.

    seen: host, domain, declared and suffix counts of each record's keys by language (0 without a key); a record's own part
    is taken out.
    """
    own = {k: np.maximum(0, c - p) for k, c in seen.items()}
    total = {k: c.sum(1, keepdims=True) for k, c in own.items()}
    domain = (own["domain"] + DOMAIN * everywhere) / (total["domain"] + DOMAIN)
    prior = (own["host"] + HOST * domain) / (total["host"] + HOST)
    # P(evidence | language) / P(evidence), by Bayes from the evidence's own language counts
    lift = [(own[k] + SEEN * everywhere) / (total[k] + SEEN) / everywhere for k in ("declared", "suffix")]
    return ll + np.log(prior) + np.log(lift[0]) + np.log(lift[1])


KEYS = ("host", "domain", "declared", "suffix")


def identify(records: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """kind, id, lang, confidence, text_lang for each record."""
    langs = model[0]
    if not langs:
        return records.select("kind", "id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    n = len(langs)
    base = written(likelihoods(records, model), "langid")
    total = np.zeros(n)
    for r in base.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row for each language
        total[r["i"]] = r["x"]
    everywhere = (total + 1) / (total.sum() + n)
    # a record without a key meets no counts; its salt spreads such records over all tasks
    salt = F.pmod(F.xxhash64("kind", "id"), F.lit(SALTS))
    joined = base
    for key in KEYS:
        sums = base.filter(F.col(key).isNotNull()).select(key, F.posexplode("p").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
        packed = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col(key).alias("k"), F.lit(0).cast("long").alias("z"), F.transform("c", lambda c: c["x"]).alias(f"n_{key}"))
        here = joined.withColumn("z_", F.when(F.col(key).isNull(), salt).otherwise(0))
        joined = here.join(packed, (F.col(key) == F.col("k")) & (F.col("z_") == F.col("z")), "left").drop("k", "z", "z_")

    @trimmed
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs)
        for batch in batches:
            if not batch.num_rows:
                continue
            ll, p = (batch.column(c).flatten().to_numpy().reshape(-1, n) for c in ("ll", "p"))
            seen = {}
            for key in KEYS:
                lists = batch.column(f"n_{key}")
                seen[key] = np.zeros(ll.shape)
                there = lists.is_valid().to_numpy(zero_copy_only=False)
                seen[key][there] = lists.flatten().to_numpy().reshape(-1, n)
            score = fused(ll, p, seen, everywhere)
            top = score.max(1, keepdims=True)
            lang, alone = (names.take(pa.array(x.argmax(1))) for x in (score, p))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), lang, pa.array(1 / np.exp(score - top).sum(1)), alone], ["kind", "id", "lang", "confidence", "text_lang"])

    return joined.select("kind", "id", "ll", "p", *[f"n_{k}" for k in KEYS]).mapInArrow(told, "kind string, id long, lang string, confidence double, text_lang string")


def page_records(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    path = F.regexp_extract("url", r"://[^/]+/([a-z]{2})(?:/|$)", 1)
    return pages.select(
        F.lit("page").alias("kind"),
        F.col("page_id").cast("long").alias("id"),
        F.col("html").alias("text"),
        host.alias("host"),
        F.when(host.isNotNull(), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host.isNotNull(), F.concat(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("/"), path)).alias("suffix"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text", F.concat(F.lit("source:"), F.col("source")).alias("host"), none.alias("domain"), none.alias("declared"), none.alias("suffix"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """All documents and all pages: doc_id or page_id, the language and what the text alone says."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    out = identify(document_records(docs).unionByName(page_records(pages)), train(docs))
    return out.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "lang", "confidence", "text_lang")
