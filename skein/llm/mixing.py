"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight; no target exceeds `most` times its source's words, and what is cut off is
shared again by weight until none exceeds. A document's rate is target / source size: its whole part is copies that
every document of the source gets for certain. The rest f in [0, 1) is one Pareto sample of fixed size in words:
document i has an inclusion probability p_i = min(1, c * w_i), where w_i is its weight and c is solved for each source
until the expected words are f times the source's, clipped documents included; a uniform number u_i made from a hash of
its id, its text and the seed; and the rank (u_i / (1 - u_i)) / (p_i / (1 - p_i)). The least ranks are taken until their
words come nearest to the words wanted. By default w_i = ln(1 + words), so that scraps are repeated less than full
texts.

Texts are read once: ids, sizes, weights and uniform numbers go to a narrow table, from which everything else follows.
The cut is found without gathering a source: words by source and 4096ths of the ranks' range are summed, a running sum
names the one cell that holds the cut, which is divided again until it holds few documents. One row for each source
(sums, plan, cut) reaches the driver.

Defined results: null and blank texts have size 0 and are never counted; a null source is a source, last in order.
Null, negative and non-finite weights are 0: such documents come last in the sample. A source without words has target
0. Rows with a null id are documents of their own; documents of equal rank are ordered by id, then size, and rows that
agree in these (repeated rows) share their fate. Reruns agree. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import count_words, lean, remove, written

CELLS = 4096
#: Documents of a source's cell that are ordered in one task at most; a cell of more is divided again.
ORDERED = 100_000
_UNIFORM = 1 << 52
#: Rows of the plan up to which it is broadcast.
FEW = 100_000


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of matches of [^\\x20\\x09-\\x0D]+ in each text, 0 for a null."""
    return pa.array(count_words(texts))


def allocate(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source. sizes: one pair per source (as many as there are sources, not rows)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    left, free, out = share * sum(n for _, n in order), dict(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s, n in free.items() if left * weight[s] / total >= most * n]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * free.pop(s)
        left = max(0.0, share * sum(n for _, n in order) - sum(out.values()))
    return out


def _uniform(id_col: str, text_col: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)), F.lit(_UNIFORM)) + F.lit(0.5)) / F.lit(float(_UNIFORM))


def _weight(size: Column, given: Column | None) -> Column:
    return F.log1p(size.cast("double")) if given is None else F.when((given > 0) & (given < float("inf")), given).otherwise(0.0)


def _chance(w: Column) -> Column:
    """Inclusion probability of the fractional part; __c is null where every document with a weight is wanted."""
    return F.when(w <= 0, F.lit(0.0)).when(F.col("__c").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("__c") * w))


def _rank(u: Column, p: Column) -> Column:
    """The Pareto rank r as r / (1 + r), which runs from 0 to 1; 1 if it can't be drawn."""
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))


def _with(df: DataFrame, source: str, rows: list[tuple], fields: str) -> DataFrame:
    """df and the fields of its source's row; the rows, one for each source, begin with the source."""
    plan = df.sparkSession.createDataFrame(rows, f"__p string, {fields}")
    return df.join(F.broadcast(plan) if len(rows) <= FEW else plan, F.col(source).eqNullSafe(F.col("__p"))).drop("__p")


def _solve(narrow: DataFrame, wanted: dict[str | None, float]) -> dict[str | None, float | None]:
    """c of each source: words * min(1, c * w) add up to the wanted words; None where every weight is clipped. A round takes
    those that the last c clips as certain; they only grow in number, and when no source's do, all are solved."""
    c, clipped = dict.fromkeys(wanted, 0.0), dict.fromkeys(wanted, -1)
    heavy = narrow.filter("size > 0 and w > 0").select("s", "size", "w")
    while True:
        full = F.col("__c").isNull() | (F.col("__c") * F.col("w") >= 1)
        sums = _with(heavy, "s", list(c.items()), "__c double").groupBy("s").agg(F.sum(F.when(full, F.col("size")).otherwise(0)).alias("all"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("w"))).alias("part"))
        moved = False
        for s, certain, part in sums.collect():  # one row per source
            moved |= certain != clipped[s]
            clipped[s] = certain
            if c[s] is not None:
                c[s] = max(c[s], (wanted[s] - certain) / part) if part > 0 else None
        if not moved:
            return c


def _cuts(ranked: DataFrame, want: dict[str | None, float]) -> dict[str | None, tuple]:
    """The key (rank, id, size) of the last document that each source takes. ranked: s, r, k and size."""
    at = dict.fromkeys(want, (0.0, 1.0, 0.0))  # of the cell that holds the cut: least rank, width, the words before
    for _ in range(4):
        cell = F.least(F.floor((F.col("r") - F.col("__lo")) / F.col("__width") * CELLS), F.lit(CELLS - 1))
        inside = _with(ranked, "s", [(s, *x, want[s]) for s, x in at.items()], "__lo double, __width double, __before double, __want double").withColumn("cell", cell)
        sums = inside.filter("cell >= 0 and r <= __lo + __width").groupBy("s", "cell", "__before", "__want").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = sums.withColumn("before", F.col("__before") + F.sum("words").over(Window.partitionBy("s").orderBy("cell")) - F.col("words"))
        hit = run.filter((F.col("before") < F.col("__want")) & (F.col("before") + F.col("words") >= F.col("__want")))
        rows = hit.groupBy("s").agg(F.min(F.struct("cell", "before", "n")).alias("x")).select("s", "x.*").collect()  # one row per source
        at = {s: (at[s][0] + cell * at[s][1] / CELLS, at[s][1] / CELLS, before) for s, cell, before, _ in rows}
        if max((r["n"] for r in rows), default=0) <= ORDERED:
            break
    if not at:
        return {}
    here = _with(ranked, "s", [(s, *x, want[s]) for s, x in at.items()], "__lo double, __width double, __before double, __want double").filter(F.col("r").between(F.col("__lo"), F.col("__lo") + F.col("__width")))
    # repeated rows are taken together, so they count together
    here = here.groupBy("s", "r", "k", "size", "__before", "__want").agg(F.sum("size").alias("words"))
    so_far = F.col("__before") + F.sum("words").over(Window.partitionBy("s").orderBy("r", "k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    taken = here.withColumn("so_far", so_far).filter(F.col("so_far") + F.col("words") / 2 <= F.col("__want"))
    last = {r["s"]: tuple(r["last"]) for r in taken.groupBy("s").agg(F.max(F.struct("r", "k", "size")).alias("last")).collect()}  # one row per source
    # where nothing of the cut's cell fits, all before it is taken
    return {s: last.get(s, (lo, "", -1)) for s, (lo, _, _) in at.items()}


_PLAN = "source_size long, target double, __whole int, __part boolean, __c double, __r double, __k string, __size long"


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, list[tuple]]:
    """The narrow table (s, id, size, w, u, k) and the plan, one row for each source."""
    lean(docs.sparkSession)
    given = F.lit(None).cast("double") if weight_col is None else F.col(weight_col).cast("double")
    narrow = docs.select(F.col(source_col).cast("string").alias("s"), F.col(id_col).alias("id"), word_count(text_col).alias("size"), _uniform(id_col, text_col, seed).alias("u"), given.alias("g"))
    narrow = written(narrow, "mixing").withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("w", _weight(F.col("size"), None if weight_col is None else F.col("g")))
    per = {r["s"]: r["n"] for r in narrow.groupBy("s").agg(F.sum("size").alias("n")).collect()}  # one row per source
    target = allocate(list(per.items()), weights, share, most)
    whole = {s: int(target[s] / n + 1e-9) if n else 0 for s, n in per.items()}
    want = {s: target[s] - whole[s] * n for s, n in per.items()}
    want = {s: x for s, x in want.items() if x > 1e-6 * max(1, per[s])}
    c, cut = {}, {}
    if want:
        c = _solve(narrow, want)
        ranked = _with(narrow.filter("size > 0"), "s", list(c.items()), "__c double")
        cut = _cuts(ranked.select("s", "k", "size", _rank(F.col("u"), _chance(F.col("w"))).alias("r")), want)
    return narrow, [(s, int(n), float(target[s]), whole[s], s in want, c.get(s), *cut.get(s, (None, None, None))) for s, n in per.items()]


def _decided(rows: DataFrame, source: str, plan: list[tuple], k: Column, u: Column, w: Column) -> DataFrame:
    """rows (with size) and what the plan says of each."""
    out = _with(rows, source, plan, _PLAN).withColumn("chance", F.when(F.col("__part"), _chance(w)).otherwise(0.0)).withColumn("rank", _rank(u, F.col("chance")))
    key, last = (F.struct(r.alias("r"), i.alias("k"), n.alias("n")) for r, i, n in ((F.col("rank"), k, F.col("size")), (F.col("__r"), F.col("__k"), F.col("__size"))))
    # a source whose sample has no cut takes all of it
    take = F.col("__part") & (F.col("size") > 0) & (F.col("__r").isNull() | (key <= last))
    return out.withColumn("copies", F.col("__whole") + F.coalesce(take, F.lit(False)).cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


_MADE = ["size", "source_size", "target", "copies", "taken", "chance", "rank"]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies (0 .. most), taken (words), chance (of the fractional part) and rank; all
    its columns stay in front.

    Clashing columns of docs are replaced, unless they are the id, text, source or weight.
    """
    narrow, plan = _plan(docs, id_col, text_col, source_col, weight_col, weights, share, most, seed)
    remove(docs.sparkSession, narrow)
    given = F.lit(None).cast("double") if weight_col is None else F.col(weight_col).cast("double")
    # one struct keeps the columns of docs apart from those made here
    rows = docs.select(F.struct("*").alias("__row"), word_count(text_col).alias("size"), _uniform(id_col, text_col, seed).alias("__u"), given.alias("__g"), F.col(source_col).cast("string").alias("__s"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__i"))
    rows = rows.withColumn("__w", _weight(F.col("size"), None if weight_col is None else F.col("__g")))
    out = _decided(rows, "__s", plan, F.col("__i"), F.col("__u"), F.col("__w"))
    own = [c for c in docs.columns if c not in _MADE or c in (id_col, text_col, source_col)]
    return out.select(*[F.col("__row")[c].alias(c) for c in own], *[c for c in _MADE if c not in own])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """id, size, source_size, target, copies, taken, chance and rank of every row: mix_sources() without the documents, whose
    texts are read once only."""
    narrow, plan = _plan(docs, id_col, text_col, source_col, weight_col, weights, share, most, seed)
    return _decided(narrow, "s", plan, F.col("k"), F.col("u"), F.col("w")).select("id", *_MADE)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "chance", "rank")
