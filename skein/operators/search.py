"""BM25 over two fields, vector search, and their merge by reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_url, basic_tokens, entity_url
from ..functions.vectors import top_k as nearest

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenized(docs: DataFrame, fields: list[str], tokens=basic_tokens) -> DataFrame:
    """field, doc_idx, dl (tokens in all), term: each field's text is tokenized once."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])
    one = docs.select("doc_idx", F.explode(each).alias("f")).select("f.field", "doc_idx", F.size("f.t").alias("dl"), "f.t")
    return one.select("field", "doc_idx", "dl", F.explode_outer("t").alias("term"))


def build_index(docs: DataFrame, fields: list[str], tokens=basic_tokens) -> DataFrame:
    """The postings field, term, doc_idx, tf, dl; a document without tokens has one row of a null term, so that it counts.
    ValueError for an empty corpus."""
    if docs.isEmpty():
        raise ValueError("there is nothing to index")
    return tokenized(docs, fields, tokens).groupBy("field", "term", "doc_idx").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def write_index(index: DataFrame, path: str) -> None:
    """Stored by field; the rows of a term lie together, so that a query reads few of them."""
    index.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_stats(index: DataFrame) -> DataFrame:
    """field, docs, avgdl and mean_idf. Documents and lengths are told by the first term of each document; the frequencies
    of terms are counted without their documents."""
    terms = index.filter("term is not null").groupBy("field", "term").agg(F.count("*").alias("n"))
    size = index.groupBy("field", "doc_idx").agg(F.first("dl").alias("dl")).groupBy("field").agg(F.count("*").alias("docs"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"))
    idf = terms.join(F.broadcast(size), "field").groupBy("field").agg(F.avg(_idf()).alias("mean_idf"), F.count("*").alias("terms"))  # a row for each field
    return size.join(idf, "field", "left")


def _idf() -> Column:
    return F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)


def bm25(index: DataFrame, query: list[str], weights: dict[str, float], stats: DataFrame | None = None) -> DataFrame:
    """doc_idx and score of documents with a query term: the weighted sum over fields. Negative idf is a quarter of the mean
    idf; repeated query terms count again. Of the index only the query's rows are scored."""
    stats = index_stats(index) if stats is None else stats
    times = {}
    for w in query:
        times[w] = times.get(w, 0) + 1
    hits = index.filter(F.col("term").isin(list(times)) & F.col("field").isin(list(weights)))
    n = hits.groupBy("field", "term").agg(F.count("*").alias("n"))
    count, weight = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (times, {f: float(max(0.0, w)) for f, w in weights.items()}))
    q = n.join(F.broadcast(stats), "field").withColumn("idf", _idf())
    q = q.select("field", "term", (weight[F.col("field")] * count[F.col("term")] * F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))).alias("w"), "avgdl")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(q), ["field", "term"]).groupBy("doc_idx").agg(F.sum(part).alias("score"))  # as many rows as query words


def keyword_search(docs: DataFrame, query: str, k: int, title_field: str | None = None, w_title: float = 2.0, w_body: float = 1.0, body_field: str = "raw_text", index: DataFrame | None = None, tokens=basic_tokens) -> DataFrame:
    """doc_idx, title, score, rank (from 0) of the best k; documents without a query term fill the list with score 0. A query
    without tokens finds nothing. Without an index (see build_index) documents are scanned for the query's words."""
    words = query.lower().split()
    weights = {body_field: w_body} | ({title_field: w_title} if title_field else {})
    if not words:
        return docs.select("doc_idx", "title", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    stats = None
    if index is None:
        if docs.isEmpty():
            raise ValueError("there is nothing to index")
        index, stats = query_postings(docs, list(weights), words, tokens), scan_stats(docs, list(weights), tokens)
    total = bm25(index, words, weights, stats).select("doc_idx", F.round("score", 6).alias("score"))
    full = docs.select("doc_idx", "title").join(total, "doc_idx", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(full.orderBy(F.desc("score"), "doc_idx").limit(k), F.desc("score"))


def _field_tokens(docs: DataFrame, fields: list[str], tokens) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])
    return docs.select("doc_idx", F.explode(each).alias("f")).select("f.field", "doc_idx", F.size("f.t").alias("dl"), "f.t")


def scan_stats(docs: DataFrame, fields: list[str], tokens=basic_tokens) -> DataFrame:
    """index_stats() of a corpus without an index: words are counted once a document, and combined before the shuffle."""
    rows = _field_tokens(docs, fields, tokens)
    size = rows.groupBy("field").agg(F.count("*").alias("docs"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"))
    terms = rows.select("field", F.explode(F.array_distinct("t")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("n"))
    idf = terms.join(F.broadcast(size), "field").groupBy("field").agg(F.avg(_idf()).alias("mean_idf"), F.count("*").alias("terms"))  # a row for each field
    return size.join(idf, "field", "left")


def query_postings(docs: DataFrame, fields: list[str], words: list[str], tokens=basic_tokens) -> DataFrame:
    """The rows of build_index() for some words only, counted within each document."""
    def count(word: str) -> Column:
        return F.struct(F.lit(word).alias("term"), F.size(F.filter("t", lambda x: x == word)).alias("tf"))

    times = F.array(*[count(w) for w in dict.fromkeys(words)])
    rows = _field_tokens(docs, fields, tokens).select("field", "doc_idx", "dl", F.explode(times).alias("x"))
    return rows.select("field", "x.term", "doc_idx", "x.tf", "dl").filter("tf > 0")


def clamp(top_k: int, least: int = 1, most: int = 50) -> int:
    return min(most, max(least, top_k))


def request(docs: DataFrame, query: str, top_k: int, search) -> DataFrame:
    """search(query, k) with k clamped; a blank query finds nothing."""
    found = search(query.strip() or " ", clamp(top_k))
    return found if query.strip() else found.limit(0)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], top_k: int = 10, w_semantic: float = 0.5, w_keyword: float = 0.5, cluster_id: int | None = None, k: int = 60) -> DataFrame:
    """title, score, rank (from 1) of the table-backed search: 2 * top_k rows of either side, vectors by cosine and documents
    by full text, merged by reciprocal ranks under weights that are scaled to sum 1. The cluster filter holds for the
    vectors' side only; a side of weight 0 isn't asked."""
    total = w_semantic + w_keyword
    w_semantic, w_keyword = (w_semantic / total, w_keyword / total) if total > 0 else (w_semantic, w_keyword)
    near = vectors.filter("embedding is not null")
    near = near.filter(F.col("cluster_id") == cluster_id) if cluster_id is not None else near
    sides = []
    if w_semantic > 0:
        sides.append(ranked(nearest(near, vector, 2 * top_k), F.col("dist"), 1).select("title", "rank", F.lit(float(w_semantic)).alias("w"), F.lit(0).alias("side")))
    if w_keyword > 0:
        sides.append(ranked(full_text(docs, query, 2 * top_k), F.desc("score"), 1).select("title", "rank", F.lit(float(w_keyword)).alias("w"), F.lit(1).alias("side")))
    if not sides:
        return docs.select("title", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    merged = both.groupBy("title").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("side", "rank")).alias("seen"))
    # ties in the order in which titles were first seen: the vectors' side, then the text's
    top = merged.orderBy(F.desc("score"), "seen", "title").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seen", "title"))).select("title", "score", "rank")


def ranked(top: DataFrame, order, base: int = 0) -> DataFrame:
    """top (k rows) with rank; ties by doc_idx."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(order, "doc_idx")) - 1 + base)


def rrf(semantic: DataFrame, keyword: DataFrame, k: int = 60, w_semantic: float = 1.0, w_keyword: float = 1.0) -> DataFrame:
    """title, score, best_rank: the sum of w / (k + rank) over both rankings."""
    both = semantic.select("title", "rank", F.lit(float(w_semantic)).alias("w"), F.lit(0).alias("side")).unionByName(keyword.select("title", "rank", F.lit(float(w_keyword)).alias("w"), F.lit(1).alias("side")))
    return both.groupBy("title").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))


def rrf_first_seen(semantic: DataFrame, keyword: DataFrame, k: int = 60, limit: int = 10) -> DataFrame:
    """title, score, best_rank and position (from 0) of the best by rrf(): equal scores keep the order in which the titles
    were first seen, the semantic ranking first, then the other."""
    both = semantic.select("title", "rank", F.lit(0).alias("side")).unionByName(keyword.select("title", "rank", F.lit(1).alias("side")))
    one = both.groupBy("title").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.min(F.struct("side", "rank")).alias("seen"))
    top = one.orderBy(F.desc("score"), "seen").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "seen")) - 1).drop("seen")  # `limit` rows


def full_text(docs: DataFrame, query: str, k: int) -> DataFrame:
    """Documents with every query word, by the words' count over the length."""
    words = list(dict.fromkeys(query.lower().split()))
    p = docs.select("doc_idx", "title", basic_tokens(F.concat_ws(" ", "title", "raw_text")).alias("t"))
    for w in words:
        p = p.filter(F.array_contains("t", w))
    hits = F.size(F.filter("t", lambda x: x.isin(words)))
    return p.select("doc_idx", "title", F.round(hits / F.size("t"), 9).alias("score")).orderBy(F.desc("score"), "doc_idx").limit(k)


def enrich(hits: DataFrame, docs: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """hits with url, cluster, five categories, link_count and, from a cache (title in lower case, qid), the entity and its
    url. Of titles that differ in case only, the first document's row is taken."""
    meta = docs.select(F.lower("title").alias("key"), "doc_idx", "cluster_id", F.slice("categories", 1, 5).alias("categories"), (F.size(F.coalesce("links", F.array().cast("array<string>"))) if "links" in docs.columns else F.lit(0)).alias("link_count"))
    keys = hits.select(F.lower("title").alias("key")).distinct()
    first = meta.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_idx", "cluster_id", "categories", "link_count")).alias("m")).select("key", "m.cluster_id", "m.categories", "m.link_count")
    out = hits.withColumn("key", F.lower("title")).join(first, "key", "left").withColumn("url", article_url(F.col("title")))
    out = out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).withColumn("link_count", F.coalesce("link_count", F.lit(0)))
    if cache is not None:
        out = out.join(cache.select(F.col("title").alias("key"), "qid"), "key", "left").withColumn("entity_url", entity_url(F.col("qid")))
    return out.drop("key")
