"""Text functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stem import porter

#: The stop words of the keyword tokenizer.
STOP_WORDS = "a an the and or but if then else when where why how all any both each few more most other some such no nor not only own same so than too very can will just don should now is am are was were be been being have has had do does did in on at by for from of to as this that these those it its he she they you we i".split()
SPACE = "[ \\t\\n\\r\\f]"
KEYWORD = r"([a-zA-Z][a-zA-Z\-']+)"
#: The colors of clusters, by their number modulo ten, and that of no cluster.
COLORS = ["#3b82f6", "#ef4444", "#10b981", "#f59e0b", "#8b5cf6", "#ec4899", "#06b6d4", "#84cc16", "#f97316", "#6366f1"]
GREY = "#64748b"
#: The stages that a logger's name may tell.
LOGGED_STAGES = ["ingestion", "preprocessing", "clustering", "build_graph"]


def clean_text(c: Column) -> Column:
    """[[x]] becomes x; {{..}} and <..> go; white space collapses."""
    c = F.regexp_replace(c, r"\[\[([^\]]+)\]\]", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\{\{[^}]+\}\}", ""), "<[^>]+>", "")
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def keyword_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(KEYWORD), 1), is_keyword)


def is_keyword(term: Column) -> Column:
    """Whether a term counts: three letters or more, and no stop word (a set that is hashed once)."""
    return (F.length(term) >= 3) & ~term.isin([w for w in STOP_WORDS if len(w) > 2])


def simple_normalize(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9 \t\n\r\f]+", " ")
    return F.regexp_extract_all(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(r"([a-zA-Z0-9][a-zA-Z0-9\-']+)"), 1)


def normalize_text(c: Column, stop_words: list[str] | None = None, stem: bool = False) -> Column:
    """Normalized tokens without stop words, joined by blanks; with stem, reduced by Porter's algorithm."""
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    kept = F.filter(simple_normalize(c), lambda x: ~x.isin(stop)) if stop else simple_normalize(c)
    return F.array_join(stemmed(kept) if stem else kept, " ")


def stemmed(tokens: Column) -> Column:
    """An array of words reduced to their stems, in Arrow batches; each distinct word is reduced once a batch."""
    @F.arrow_udf(ArrayType(StringType()))
    def run(lists: pa.Array) -> pa.Array:
        rows = lists.to_pylist()
        stems = {w: porter(w) for w in {w for x in rows if x for w in x}}
        return pa.array([x and [stems[w] for w in x] for x in rows], pa.list_(pa.string()))

    return run(tokens)


def normalize_corpus(docs: DataFrame, text: str = "raw_text", out: str = "normalized", **options) -> DataFrame:
    return docs.withColumn(out, normalize_text(F.col(text), **options))


def prepared_tokens(normalize: bool = False, **options):
    """The tokenizer of an index: normalized words, or lower-cased words between white space."""
    return (lambda c: F.filter(F.split(normalize_text(c, **options), " "), lambda x: x != "")) if normalize else basic_tokens


def basic_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda x: x != ""))


def article_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """Blanks become underscores; the rest is percent-encoded as RFC 3986 unreserved characters demand."""
    enc = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    enc = F.replace(F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(base), enc)


def entity_url(qid: Column, base: str = "https://www.wikidata.org/wiki/") -> Column:
    return F.concat(F.lit(base), qid)


def highlight(c: Column, query: str) -> Column:
    """Every query word in <mark>, whatever its case."""
    import re

    words = [re.escape(w) for w in query.split()]
    return F.regexp_replace(c, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else c


def mask_password(c: Column) -> Column:
    return F.regexp_replace(c, "(://[^:/@]+:)[^@]+@", "$1***@")


def metric_name(c: Column) -> Column:
    return F.translate(c, "/-", "__")


def log_level(c: Column) -> Column:
    return F.when(c == "CRITICAL", "ERROR").when(c.isin("DEBUG", "INFO", "WARNING", "ERROR"), c).otherwise("INFO")


#: Fixed value: what tells that a service wants fewer requests.
RATE_LIMIT = "(?i)429|too many requests|rate limit"


def is_rate_limit(c: Column) -> Column:
    return c.rlike(RATE_LIMIT)


def is_rate_limit_text(message: str) -> bool:
    import re

    return bool(re.search(RATE_LIMIT, message))


def label(c: Column, size: int = 50) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def layer_number(c: Column) -> Column:
    return F.when(c == "link", 1).when(c == "cluster", 2).when(c == "semantic", 3).otherwise(0)


def clean_links(c: Column) -> Column:
    """Null becomes empty, names are trimmed, blanks and nulls go."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def stage_of_logger(name: Column) -> Column:
    """The first known stage in the name of a logger of a stage or subprocess, else null."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for stage in reversed(LOGGED_STAGES):
        out = F.when(low.contains(stage), stage).otherwise(out)
    return F.when(name.contains("subprocess") | low.contains("stage"), out)


def cluster_color(c: Column) -> Column:
    return F.when(c < 0, GREY).otherwise(F.element_at(F.array(*map(F.lit, COLORS)), (F.pmod(c, F.lit(len(COLORS))) + 1).cast("int")))


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")


def jdbc_url(url: str, scheme: str = "jdbc:postgresql://") -> str:
    """postgres:// and postgresql:// (with any driver suffix) as the scheme that Spark's reader takes, without user and password."""
    import re

    return re.sub(r"^postgres(?:ql)?(?:\+\w+)?://(?:[^/@]*@)?", scheme, url)
