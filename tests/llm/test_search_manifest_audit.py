"""op11 to op13: against brute force, their edge cases, and the parts that prune and rank."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import audit, merkle, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, good int, rank long, tree string, leaf string, digest string"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    """(doc_id, text, lang, source, n_chars), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, 3, "t", "l", "d") for r in rows], DOCS)


ODD = [
    (0, None, "en", "b", None),
    (1, "", "en", "b", 0),
    (2, "Some words  HERE", None, "a", 16),
    (3, "some\x0bother\twords & more", "", None, 9),
    (3, "some\x0bother\twords & more", "", None, 9),
    (3, "another text of id 3", "", "", 9),
    (-(2**63), "ÀÉ lowest", "fr", "a", 2),
    (2**63 - 1, "Highest", "fr", "a", 2),
    (None, "no Id", "fr", "a", 2),
    (None, "no Id", "fr", "a", 2),
    (None, None, None, None, None),
    (7, "word " * 60, "en", "b", 1),
    (8, " ".join(f"w{i}" for i in range(60)), "en", "b", 1),
    (9, " ".join(f"w{i}" for i in range(60)), "en", "c", 1),
    (10, "Long " * 200_000, "en", "c", 1),
    (11, "İi  x y", "zz", "c", 1),
]


# --- op11


def brute_top(rows, k=20, every=20):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            others = [(-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(kept) if n != at and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def told(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 700)] + 0.1 * rng.normal(size=(700, 16))
    x[100:160] = x[100]  # ties
    rows = [(i - 300, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert told(topk.search(df)) == brute_top(rows)
    assert told(topk.search(df, k=3, every=50)) == brute_top(rows, 3, 50)


def test_top_k_edge_cases(spark):
    rows = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [0.0, 0.0]), (20, []), (6, []), (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0]), (60, [2.0, 1.0]), (-20, [-0.01, 0.3]), (7, [1e9, 1e9])]
    df = spark.createDataFrame([(*r, 1, 2, "x", 5) for r in rows], "vec_id long, embedding array<double>, score int, rank int, found string, d int")
    assert told(topk.search(df)) == brute_top(rows)
    assert topk.search(df.limit(0)).collect() == []
    # beyond 53 bits, beyond a long, beyond a double
    big = [(0, [3e15, 1.0]), (1, [3e15, 1.5]), (2, [-3e300, 1.0]), (3, [1.7e308, 0.0])]
    got = told(topk.search(spark.createDataFrame(big, "vec_id long, embedding array<double>")))
    least, most = 1 - 2**63, 2**63 - 1
    assert got == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 2, least)]


def test_exact_scores_beyond_doubles():
    q, x = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**30 + 1, 1.0], [2.0**29, -5.0]])
    assert topk.scores(q, x).tolist() == [[(2**30 + 1) ** 2 + 3, (2**30 + 1) * 2**29 - 15]]


def test_bounds_hold_and_blocks_are_left_out():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24)) * 40
    x = np.floor(np.repeat(centers, topk.BLOCK, 0) + rng.normal(size=(40 * topk.BLOCK, 24)))
    shard = topk.Shard(np.arange(len(x)), x)
    q = x[::500]
    bound = topk.bounds(q, shard.high, shard.low)
    real = (q @ x.T).reshape(len(q), 40, topk.BLOCK).max(2)
    assert (bound >= real).all()
    who, place, score, least = shard.search(q, 20, np.full(len(q), -topk._LONG), np.arange(0, len(x), 500))
    assert len(who) == 20 * len(q) and shard.scored < 0.1 * len(q) * 40
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), 500)] = -np.inf
    for i in range(len(q)):
        best = sorted(zip(-s[i], range(len(x))))[:20]
        assert sorted(zip(-score[who == i], place[who == i])) == best and least[i] == -best[-1][0]


# --- op12


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(h):
    levels = [h]
    while len(levels[-1]) > 1:
        levels.append([joined(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, k):
    out = []
    for level in levels[:-1]:
        out.append(("".join(level[k // 8 * 8 : k]), "".join(level[k + 1 : k // 8 * 8 + 8])))
        k //= 8
    return out


def brute_manifest(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for i, t, lang, source, n in rows:
        leaf = joined(*map(text, (i, source, lang, n, t)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by.setdefault(lang, []).append(((i is not None, i or 0, leaf), i, leaf, joined(*map(text, (i, source, lang, n, t and t.translate(low)))) if hit else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([r[2] for r in by[x].sort(key=lambda r: r[0]) or by[x]]) for x in langs}
    top = brute_tree([trees[x][-1][0] for x in langs])
    out = []
    for j, lang in enumerate(langs):
        for k, (_, i, leaf, now) in enumerate(by[lang]):
            path = beside(trees[lang], k) + beside(top, j)
            for a, b in path:
                now = joined(a, now, b)
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], joined(*(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark):
    assert sorted(map(tuple, merkle.manifest(docs(spark, ODD)).collect()), key=repr) == brute_manifest(ODD)


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65), (513, 2)])
def test_manifest_of_many_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(-(10**6), 10**12), f"Text {i} of {g}", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows)).collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_many_groups_and_of_nothing(spark):
    rows = [(i, f"Text {i}", f"{'x' * (i % 9)}{i}", None, i) for i in range(600)]
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows)).collect()), key=repr) == brute_manifest(rows)
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_ranks_over_sparse_keys(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [5, 6, 7, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([("g", True, k, "x", 1 + k % 2) for k in keys], "g string, has boolean, key long, o string, times long")
    got = {r["key"]: (r["rank"], r.total) for r in merkle.with_ranks(rows, "g", "has", "key", ["o"], "times").collect()}
    at, want = 0, {}
    for k in sorted(keys):
        want[k] = at
        at += 1 + k % 2
    assert got == {k: (v, at) for k, v in want.items()}


# --- op13


def brute_audit(rows, labels):
    texts = [(i, t or "") for i, t, *_ in rows]
    good, toxic = ({i for i, q, x in labels if (q, x)[c] == 1 and i is not None} for c in (0, 1))
    facts = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and x == t for j, x in texts)]
        facts.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], {}
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                out.append([part, "".join("ABCDE"[j] for j in order), step, len(left) - len(gone), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1]) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
                total[f] = total.get(f, 0) + len(gone)
                left = [x for x in left if not x[1][f]]
        for r in out:
            if r[0] == part:
                r[-1] = total[r[-1]]
    return sorted(map(tuple, out))


def test_audit_equals_brute_force(spark):
    labels = [(0, 1, 0), (2, 1, 1), (2, 0, 0), (9, 1, None), (10, None, 1), (None, 1, 1), (77, 1, 1)]
    got = sorted(map(tuple, audit.audit(docs(spark, ODD), spark.createDataFrame(labels, LABELS)).collect()))
    assert got == brute_audit(ODD, labels)
    assert len(got) == 600 * len({r[3] or "" for r in ODD})


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(docs(spark, []), none).collect() == []
    out = audit.audit(docs(spark, ODD), none)
    assert out.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert [c for c, t in out.dtypes if t == "int"] == ["step"]


def test_shapley_shares_add_up_to_all_removals(spark):
    out = audit.audit(docs(spark, ODD), spark.createDataFrame([], LABELS))
    per = {r.part: r.n for r in out.groupBy("part").agg(F.sum(F.when(F.col("filter_order") == "ABCDE", F.col("removed"))).alias("n")).collect()}
    shares = {r.part: r.n for r in out.filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("n")).collect()}
    assert shares == {p: 120 * n for p, n in per.items()}
