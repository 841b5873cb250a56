"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. The driver removes this file together with the llm folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bytebpe, linededup, minhash, mixing, toxicity
from skein.llm.common import lean, table, written

#: Bytes of rows that go to Python at once: executors run all stages one after the other, and buffers of large batches stay
#: in their native memory.
BATCH_BYTES = "4m"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, row by row, whatever their ids; null and empty texts stay."""
    lean(spark, BATCH_BYTES)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; n_chars follows. A document left without lines stays, empty; a null text stays
    null. A null id orders first; rows of one id by a hash of their texts."""
    lean(spark, BATCH_BYTES)
    out = linededup.dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Rows of one id are judged by their own
    texts; rows with a null id or without words stay."""
    lean(spark, BATCH_BYTES)
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as many times as the mix takes it: 0, 1 or 2. Documents without words are no part of any target:
    they come with their source's whole copies. A null source is a source."""
    lean(spark, BATCH_BYTES)
    return mixing.mix_sources(docs).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__n")).drop("__n")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text (of each copy that the mix takes); a null text is empty."""
    lean(spark, BATCH_BYTES)
    return bytebpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash_dedup", drop_near_copies), ("mixing", mix), ("byte_bpe", tokens)]

#: SQL has no tokenizer, classifier or set-similarity join to offer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
