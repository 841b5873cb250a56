"""Filter interaction audit: what each of five filters removes in every order, from joint-failure counts.

A part's documents are counted by the failures they share: N(S) is the number of documents that fail every filter of S,
the sum over documents of the product of S's failure flags, for all 32 sets S. Everything else follows by inclusion and
exclusion, so no order is ever run over documents:

* survivors of a set M: the sum of (-1)^|T| N(T) over T within M (the Möbius inversion at "fails none of M");
* removed at a step: survivors before less survivors after; redundant: N({f}) less removed;
* unique failures of f: survivors of all others less survivors of all;
* Shapley: the removals as a game v(M) have the Harsanyi dividends d(T) = (-1)^(|T| + 1) N(T), each shared evenly by T's
  filters, so that f's removals over all 120 orders are the sum of d(T) 120 / |T| over T with f: whole numbers.

Texts are read once, for a narrow table of flags and text digests. Equal texts are found by the least id of each digest
(combined before the shuffle), and a row is the first of its text if it matches (digest, least id), a key that no group of
copies shares: large groups of copies meet nowhere. Flags are then counted by part and failure pattern, at most 32 rows
a part and task, before the products are summed.

Defined results: a null text is the empty text (fails A, and E after an earlier one). A null source is the part ''. Rows
with a null id don't fail E, and no row fails E because of them; they have no labels. Repeated rows each count, and rows
of one id don't make each other fail E. A document is good (toxic) if any label row of its id says 1. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, remove, table, trimmed, utf8, written

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
#: What is counted of the documents of a set.
COUNTS = ("n", "good", "toxic")
_ODD, _UPPER = b"#$%&*|", bytes(range(65, 91))
#: Bytes that begin a code point.
_POINTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def flags(text: bytes) -> tuple[bool, bool, bool, bool]:
    """The failures A to D: too few words, too few distinct ones, too many capitals, odd symbols."""
    words = text.split()  # at the same six bytes
    points = len(text) - len(text.translate(None, _POINTS))
    return len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * points, len(text.translate(None, _ODD)) < len(text)


@trimmed
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, digests = [], []
        for text in utf8(batch.column(2)):
            low.append(flags(text))
            digests.append(hashlib.sha256(text).digest())
        failed = [pa.array([int(f[i]) for f in low], pa.int32()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *failed, pa.array(digests, pa.binary())], ["id", "part", *FILTERS[:4], "digest"])


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, the failures A to D as 0 or 1, and the digest of the text."""
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_read, "id long, part string, A int, B int, C int, D int, digest binary")


def joint_failures(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, and n, good and toxic: arrays of the 32 joint-failure counts, by the sets' numbers (A is bit 0).

    rows: what flagged() returns, written.
    """
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumn("first", F.lit(True))
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    named = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    last = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    each = rows.join(first, ["digest", "id"], "left").withColumn("E", last).join(named, "id", "left")
    cells = each.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))

    # in SQL text: hundreds of terms, each a call to the JVM otherwise
    sums = {c: ", ".join("sum(" + " * ".join([c, *(f for i, f in enumerate(FILTERS) if s >> i & 1)]) + ")" for s in SETS) for c in COUNTS}
    return cells.groupBy("part").agg(*[F.expr(f"array({x})").alias(c) for c, x in sums.items()])


def _dots(matrix: list[list[int]], counts: str) -> Column:
    """The product of each row with the counts."""
    rows = ", ".join(f"array({', '.join(map(str, row))})" for row in matrix)
    return F.expr(f"transform(array({rows}), row -> aggregate(zip_with(row, {counts}, (k, n) -> k * n), 0L, (x, y) -> x + y))")


def inverted(joint: DataFrame) -> DataFrame:
    """part, n, and by inclusion and exclusion: survivors (<count>_alive, 32 of each) and shares (Shapley, by filter)."""
    inversion = [[(-1) ** t.bit_count() if t & m == t else 0 for t in SETS] for m in SETS]
    every = factorial(len(FILTERS))
    shapley = [[(-1) ** (t.bit_count() + 1) * every // t.bit_count() if t >> i & 1 else 0 for t in SETS] for i in range(len(FILTERS))]
    return joint.select("part", "n", *[_dots(inversion, c).alias(f"{c}_alive") for c in COUNTS], _dots(shapley, "n").alias("shares"))


def interactions(parts: DataFrame) -> DataFrame:
    """A row for each part, filter order and step, from inverted()."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(FILTERS[j] for j in order), step, i, before, before | 1 << i))
            before |= 1 << i
    # 600 fixed rows, whatever the input
    plan = F.broadcast(parts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int, after int"))
    gone = lambda c: F.get(f"{c}_alive", F.col("before")) - F.get(f"{c}_alive", F.col("after"))
    own, whole = F.col("after") - F.col("before"), len(SETS) - 1
    return parts.crossJoin(plan).select(
        "part",
        "filter_order",
        "step",
        F.get("n_alive", F.col("after")).alias("kept"),
        gone("n").alias("removed"),
        (F.get("n", own) - gone("n")).alias("redundant"),
        (F.get("n_alive", F.lit(whole) - own) - F.get("n_alive", F.lit(whole))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get("shares", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = written(flagged(docs, id_col, text_col, part_col), "audit-rows")
    parts = written(inverted(joint_failures(rows, labels, id_col)), "audit-parts")
    remove(docs.sparkSession, rows)
    return interactions(parts)


def op13_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order run over every document.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS m FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > m, false)] AS fail
  FROM w LEFT JOIN l USING (doc_id)
), o AS (SELECT unnest([{", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))}]) AS filter_order),
r AS (
  SELECT part, filter_order, good, toxic, fail, len(list_filter(fail, lambda x: x)) AS n_fails,
    coalesce(list_position(list_transform(range(1, 6), lambda i: fail[ascii(filter_order[i]) - 64]), true), 6) AS hit
  FROM f, o
), s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, count(*) FILTER (hit > step) AS kept, count(*) FILTER (hit = step) AS removed,
    count(*) FILTER (hit < step AND fail[ascii(filter_order[step]) - 64]) AS redundant, count(*) FILTER (n_fails = 1 AND fail[ascii(filter_order[step]) - 64]) AS unique_fails,
    count(*) FILTER (hit = step AND good) AS good_lost, count(*) FILTER (hit = step AND toxic) AS toxic_lost
  FROM r, range(1, 6) AS g(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
