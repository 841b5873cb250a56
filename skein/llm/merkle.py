"""Merkle manifest of a dataset: a hash tree over all rows, with ranks from digit histograms and nodes keyed by rank prefixes.

Leaves of a group (language) ascend by id. A leaf's rank is found without a sort: ids are read as digits of BITS bits, leaves
are counted by group and id prefix for each number of digits (each level from the one below), and a prefix's rank is its
parent's plus the counts of its lesser siblings, at most 2^BITS of them in a window. Only leaves that share all digits but
the last are ordered among themselves.

The tree is a trie over the ranks' base-FANOUT digits: a node is a prefix of them, and the prefix less one digit names
its parent. LEVELS digits are taken off at once: the leaves, or nodes, that share the longer prefix meet in one row of
at most FANOUT^LEVELS, which holds the subtree; a shuffle lowers the number of rows by that factor. Going down again, each
such row gets the siblings on the way from its own top to the root, and adds those inside for each leaf. Subroots of the
groups form a tree of the same kind.

Every expression is a built-in function. Each round is written to the shared folder.

Defined results: values of a leaf are told apart from nulls. Null ids come first in their group, ordered by leaf; rows of
one id are ordered by leaf; repeated rows are leaves of their own, side by side. A null group is a group, first in order.
A row with a null id is never tampered with. An empty table gives no rows; a single row is leaf, subroot and root at once,
with the proof of nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, table, written

FANOUT, LEVELS = 8, 3
_DIGIT = FANOUT.bit_length() - 1
_ROW = _DIGIT * LEVELS
#: Bits of an id's digit: the children of a prefix are ranked in one window.
BITS = 8
_PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for a null, otherwise the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def with_ranks(rows: DataFrame, group: str, first: str, key: str, order: list[str], times: str) -> DataFrame:
    """rows, and rank (from 0, of the first of `times` equal leaves) and total (of the group).

    Order: by group, then first (a boolean), key (a long) and the columns `order`. Counts by key prefix are made level by
    level; the topmost has at most 2^BITS prefixes in each group.
    """
    span = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    at = [group, first]
    level = rows.groupBy(*at, F.shiftright(key, BITS).alias("p")).agg(F.sum(times).alias("n"))
    levels, shift = [level], BITS
    while span.hi is not None and (span.hi >> shift) - (span.lo >> shift) >= 1 << BITS:
        levels.append(levels[-1].groupBy(*at, F.shiftright("p", BITS).alias("p")).agg(F.sum("n").alias("n")))
        shift += BITS
    whole = Window.partitionBy(group)
    before = lambda n, w: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    top = levels.pop()
    start = top.select(*at, "p", before("n", whole.orderBy(first, "p")).alias("start"), F.sum("n").over(whole).alias("total"))
    while levels:
        own = levels.pop().withColumn("up", F.shiftright("p", BITS))
        own = own.withColumn("before", before("n", Window.partitionBy(*at, "up").orderBy("p")))
        start = own.join(start.withColumnRenamed("p", "up"), [*at, "up"]).select(*at, "p", (F.col("start") + F.col("before")).alias("start"), "total")
    own = rows.withColumn("p", F.shiftright(key, BITS))
    own = own.withColumn("before", before(times, Window.partitionBy(*at, "p").orderBy(key, *order)))
    return own.join(start, [*at, "p"]).withColumn("rank", F.col("start") + F.col("before")).drop("p", "before", "start")


def _levels(total: Column) -> Column:
    """Levels above the leaves: the digits of the largest rank."""
    return F.when(total <= 1, F.lit(0)).otherwise(F.floor((F.length(F.bin(total - 1)) + (_DIGIT - 1)) / _DIGIT)).cast("int")


def _folded(nodes: str) -> Column:
    """The parents of a row's nodes, FANOUT at a time."""
    return F.expr(f"transform(sequence(0, cast((size({nodes}) - 1) div {FANOUT} as int)), i -> sha2(array_join(slice({nodes}, i * {FANOUT} + 1, {FANOUT}), ''), 256))")


def _rows(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """One row for each subtree of LEVELS levels at this height: tree, g, total, leaf (hash and rest of each member, in order),
    t0 .. (hashes by level) and node, the hash on top. nodes: tree, rank, total, hash, rest."""
    packed = nodes.groupBy("tree", F.shiftright("rank", _ROW).alias("g")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "hash", "rest"))).alias("leaf"))
    out = packed.withColumn("left", F.least(F.lit(LEVELS), _levels(F.col("total")) - height)).withColumn("t0", F.transform("leaf", lambda x: x["hash"]))
    for i in range(LEVELS):
        out = out.withColumn(f"t{i + 1}", F.when(F.col("left") > i, _folded(f"t{i}")))
    tops = F.coalesce(*[F.col(f"t{i}") for i in range(LEVELS, -1, -1)])
    return written(out.withColumn("node", F.get(tops, F.lit(0))), name)


def grow(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds of the trees over leaves (tree, rank, total, hash, rest), lowest first, and tree and root."""
    rounds, height = [_rows(leaves, 0, f"{name}-0")], LEVELS
    # one number
    most = rounds[0].agg(F.max(_levels(F.col("total")))).first()[0] or 0
    while height < most:
        nodes = rounds[-1].filter(_levels(F.col("total")) > height).select("tree", F.col("g").alias("rank"), "total", F.col("node").alias("hash"), F.lit(None).cast("string").alias("rest"))
        rounds.append(_rows(nodes, height, f"{name}-{len(rounds)}"))
        height += LEVELS
    root = None
    for i, r in enumerate(rounds):
        done = r.filter(_levels(F.col("total")) <= (i + 1) * LEVELS).select("tree", F.col("node").alias("root"))
        root = done if root is None else root.unionByName(done)
    return rounds, root


def _inside() -> str:
    """SQL text: left and right siblings (l, r) of a row's member x, by level, those inside the row; lowest first."""
    out = []
    for level in range(LEVELS):
        at = f"cast((x.rank & {(1 << _ROW) - 1}) div {FANOUT**level} as int)"
        begin = f"({at} & {-FANOUT})"
        left, right = f"slice(t{level}, {begin} + 1, {at} - {begin})", f"slice(t{level}, {at} + 2, {begin} + {FANOUT - 1} - {at})"
        out.append(f"struct(array_join({left}, '') as l, array_join({right}, '') as r)")
    return f"slice(array({', '.join(out)}), 1, greatest(0, left))"


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest round's rows with path (the siblings l and r from the row's top to the root) and more. above: tree, the
    path above its root, and more, which its leaves get."""
    own = None
    for i, r in reversed(list(enumerate(rounds))):
        ends = r.filter(_levels(F.col("total")) <= (i + 1) * LEVELS).select("tree")  # one row for each tree whose top is here
        begin = above.join(ends, "tree").select("tree", F.lit(0).cast("long").alias("g"), "path", "more")
        met = r.join(begin if own is None else own.unionByName(begin), ["tree", "g"])
        down = F.expr(f"transform(leaf, x -> struct(x.rank as g, concat({_inside()}, path) as path))")
        own = met.select("tree", "more", F.explode(down).alias("x")).select("tree", "x.g", "x.path", "more")
    return met


def leaves(docs: DataFrame, id_col: str, group_col: str, columns: list[str], text_col: str) -> DataFrame:
    """id, tree (the group's key, which orders as the groups do), hash, and changed: the hash after tampering, if the row is
    tampered with; times: how many rows agree in all of these."""
    changed = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain, other = ([encoded(changed if c == text_col and low else F.col(c)) for c in columns] for low in (False, True))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    return docs.select(F.col(id_col).cast("long").alias("id"), tree.alias("tree"), digest(*plain).alias("hash"), F.when(hit, digest(*other)).alias("changed")).groupBy("id", "tree", "hash", "changed").agg(F.count("*").alias("times"))


def _prefix(text: Column, size: int) -> Column:
    """The first bytes (hex digits) of a text as a number; a shorter one is filled up with zeros."""
    return F.conv(F.rpad(F.substring(text, 1, size), size, "0"), 16, 10).cast("long")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    rows = written(leaves(docs, id_col, group_col, list(columns), text_col), "merkle-leaves")
    keyed = rows.withColumn("has", F.col("id").isNotNull()).withColumn("key", F.coalesce("id", _prefix(F.col("hash"), 8)))
    ranked = with_ranks(keyed, "tree", "has", "key", ["hash", "changed"], "times")
    each = ranked.select("tree", "total", "hash", F.struct("id", "changed").alias("rest"), F.explode(F.sequence("rank", F.col("rank") + F.col("times") - 1)).alias("rank"))
    rounds, subroots = grow(each, "merkle")
    remove(spark, rows)

    # the subroots' own tree: ranked by the key's first bytes, then by the key
    top = subroots.select(F.lit("").alias("all"), F.lit(True).alias("has"), F.col("tree").alias("lang"), F.col("root").alias("hash"), F.lit(1).cast("long").alias("times"), _prefix(F.hex(F.col("tree").cast("binary")), 12).alias("key"))
    top = with_ranks(top, "all", "has", "key", ["lang"], "times")
    high, root = grow(top.select(F.col("all").alias("tree"), "rank", "total", "hash", F.col("lang").alias("rest")), "merkle-top")
    start = root.select("tree", F.array().cast(_PATH).alias("path"), F.struct("root").alias("more"))
    members = paths(high, start).select("more.root", F.explode(F.expr(f"transform(leaf, x -> struct(x.rest as tree, x.hash as subroot, concat({_inside()}, path) as path))")).alias("x"))
    above = written(members.select("x.tree", "x.path", F.struct("x.subroot", "root").alias("more")), "merkle-above")

    both, step = "array_join(transform({}, p -> concat(p.l, p.r)), '')", "(h, p) -> sha2(concat(p.l, h, p.r), 256)"
    out = paths(rounds, above).withColumn("up", F.expr(both.format("path")))
    told = f"""struct(x.rest.id as id, x.hash as leaf, sha2(concat({both.format(_inside())}, up), 256) as proof_sha256,
        aggregate(path, aggregate({_inside()}, coalesce(x.rest.changed, x.hash), {step}), {step}) as folded_root)"""
    out = out.select("more", F.explode(F.expr(f"transform(leaf, x -> {told})")).alias("x"))
    return out.select("x.id", "x.leaf", "more.subroot", "more.root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("more.root")).alias("verified"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a tree for each language."""
    return manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql(depth: int = 8) -> str:
    """The trees level by level; depth: levels above the leaves at most, for languages and for their subroots."""
    enc = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: f"sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    # crc32 of the decimal id, bit by bit
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    beside = "coalesce(string_agg(h, '') OVER ({w} ROWS BETWEEN {a} AND {b}), '')"
    w = "PARTITION BY tree, r // 8 ORDER BY r"
    left, right = beside.format(w=w, a="UNBOUNDED PRECEDING", b="1 PRECEDING"), beside.format(w=w, a="1 FOLLOWING", b="UNBOUNDED FOLLOWING")

    def climb(name: str, start: str) -> list[str]:
        """name0 .. : tree, r, h of each level; namep0 .. : each leaf's r, folded hash and proof so far."""
        out = [f"{name}0 AS ({start})", f"{name}p0 AS (SELECT tree, r AS leaf, r, x AS f, '' AS p FROM {name}0)"]
        for i in range(depth):
            more = f"(SELECT tree FROM {name}{i} GROUP BY tree HAVING count(*) > 1)"
            out.append(f"{name}s{i} AS (SELECT tree, r, {left} AS l, {right} AS rt FROM {name}{i} WHERE tree IN {more})")
            out.append(f"{name}{i + 1} AS (SELECT tree, r // 8 AS r, sha256(string_agg(h, '' ORDER BY r)) AS h FROM {name}{i} WHERE tree IN {more} GROUP BY tree, r // 8 UNION ALL SELECT tree, r, h FROM {name}{i} WHERE tree NOT IN {more})")
            out.append(f"{name}p{i + 1} AS (SELECT a.tree, leaf, coalesce(a.r // 8, 0) AS r, CASE WHEN l IS NULL THEN f ELSE sha256(l || f || rt) END AS f, p || coalesce(l || rt, '') AS p FROM {name}p{i} a LEFT JOIN {name}s{i} s ON s.tree = a.tree AND s.r = a.r)")
        return out

    steps = [f"d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS h, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS x, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents)"]
    steps += climb("n", "SELECT tree, r, h, x FROM d")
    steps += [f"roots AS (SELECT tree AS lang, h FROM n{depth})"]
    steps += climb("t", "SELECT 'all' AS tree, row_number() OVER (ORDER BY lang) - 1 AS r, h, h AS x FROM roots")
    # the proof above a language is joined on; the fold goes on from the language's own folded hash
    fold = ["z0 AS (SELECT d.doc_id, d.h AS leaf, q.h AS subroot, b.f, b.p, k.r FROM d JOIN np{n} b ON b.tree = d.tree AND b.leaf = d.r JOIN roots q ON q.lang = d.tree JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS r FROM roots) k ON k.lang = d.tree)".format(n=depth)]
    for i in range(depth):
        fold.append(f"z{i + 1} AS (SELECT doc_id, leaf, subroot, CASE WHEN l IS NULL THEN f ELSE sha256(l || f || rt) END AS f, p || coalesce(l || rt, '') AS p, a.r // 8 AS r FROM z{i} a LEFT JOIN ts{i} s ON s.r = a.r)")
    return f"WITH {', '.join(steps + fold)} SELECT doc_id, leaf, subroot, (SELECT h FROM t{depth}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM t{depth}) AS verified FROM z{depth}"


SQL = _sql()
