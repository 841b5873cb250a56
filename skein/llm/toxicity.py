"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters: the words of a small lexicon, and word and word-start patterns. The given labels only choose the patterns; they
are no voter and no part of the likelihood. The label model is a two-class mixture over the voters' votes, fitted by
expectation-maximization on labelled and unlabelled documents alike. Voters speak up for label 1 only: in class 0 their
votes are false alarms, each at a rate of its own; in class 1 they are a tree, where every voter has a hit rate given
its parent's vote, so accuracies and pairwise correlations are part of the likelihood. The tree joins the pairs of the
greatest mutual information. The first guess is that a vote means label 1. A logistic regression over hashed words and word starts is then trained on the posteriors; it alone scores texts, so labels,
language, source and ids are no inputs of a score.

Only the fit is bounded: at most `per_class` rows each that are labelled 0, labelled 1, and unlabelled, the least by a
hash of the id, outside the held-out fold and weighted back to their true shares (documented parameter); of rows that
share an id, the one whose text has the least hash. Every whole text is scored. Weights are an array of 2**20 floats,
whatever the input.

Defined results: null, empty and letterless texts have the score of no features (the model's intercept). Without any
labelled row of a class the lexicon's voters alone decide. Rows with null ids or repeated rows keep their rows, and
take no part in the fit; a document with several label rows is toxic if any says so. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prefixes, trimmed, utf8, windows, words

BITS = 20
STARTS = (4, 5, 6, 7)
#: Insults that vote for toxic wherever they stand as words.
LEXICON = "idiot moron stupid pathetic worthless scum trash loser disgusting clown imbecile dumb filth vermin retard jerk bastard".split()
_LETTERS = bytes(32 if i < 128 and not chr(i).isalpha() else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features of a text: its words of letters, and their first 4 to 7 bytes."""
    text = text.translate(_LETTERS)
    seen = windows(text)
    starts, ends, whole = words(text, seen)
    if not len(starts):
        return np.zeros(0, np.int32)
    size, all_of = ends - starts, [whole ^ np.uint64(1)]
    for m in STARTS:
        all_of.append(prefixes(seen, starts[size >= m], m) ^ np.uint64(0x5851F42D4C957F2D))
    return np.unique((np.concatenate(all_of) >> np.uint64(64 - BITS)).astype(np.int32))


def _tree(joint: np.ndarray) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of the mutual information (-1: the root). joint: 2 x 2 x voters x
    voters, the shares of each pair's votes."""
    one = np.stack([np.diag(joint[0, 0]), np.diag(joint[1, 1])])
    with np.errstate(all="ignore"):
        info = np.nan_to_num(joint * np.log(joint / (one[:, None, :, None] * one[None, :, None, :]))).sum((0, 1))
    n = len(info)
    parent, best, left = np.full(n, -1), np.full(n, -np.inf), np.ones(n, bool)
    for _ in range(n):
        j = int(np.argmax(np.where(left, best, -np.inf)))
        if not left[j]:
            j = int(np.flatnonzero(left)[0])
        left[j] = False
        nearer = left & (info[j] > best)
        best[nearer], parent[nearer] = info[j][nearer], j
    return parent


def label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 60, smooth: float = 1.0) -> dict:
    """Fits the mixture; votes: rows x voters of 0/1, start: first guess of each row's posterior, smooth: rows added to
    each count.

    Returns posterior, hit rates (on, off), prior, the voters' parents in class 1's tree, and their correlations there.
    """
    post, w = start.astype(float), weight / weight.mean()
    n, voters = votes.shape
    every, parent = np.arange(voters), np.full(voters, -1)
    for r in range(rounds):
        yes, no = w * post, w * (1 - post)
        prior = min(max(float(yes.sum() / w.sum()), 1e-4), 1 - 1e-4)
        off = np.clip((votes.T @ no + smooth / 2) / (no.sum() + smooth), 1e-9, 1 - 1e-9)
        total, own, both = yes.sum(), votes.T @ yes, votes.T @ (votes * yes[:, None])
        on = (own + smooth / 2) / (total + smooth)
        joint = np.maximum(np.array([[total - own[:, None] - own + both, own - both], [own[:, None] - both, both]]), 0)
        if r < 5:  # later rounds keep the tree, so that they settle
            parent = _tree(joint / max(total, 1e-9))
        rooted, up = parent < 0, np.where(parent < 0, every, parent)
        logit = np.log(prior / (1 - prior)) - (votes * np.log(off) + (1 - votes) * np.log(1 - off)).sum(1)
        for a in (0, 1):  # given the parent's vote a; few such rows lean on the voter's own rate
            rate = (joint[a, 1][up, every] + smooth * on) / (joint[a].sum(0)[up, every] + smooth)
            rate = np.clip(np.where(rooted, on, rate), 1e-9, 1 - 1e-9)
            given = np.where(rooted, a == 1, votes[:, up] == a)
            logit += (given * (votes * np.log(rate) + (1 - votes) * np.log(1 - rate))).sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if r >= 5 and moved < 1e-5:
            break
    rest = votes - on
    cov = rest.T @ (rest * (w * post)[:, None]) / max((w * post).sum(), 1e-9) + np.eye(voters) * 1e-9
    return {"posterior": post, "on": on, "off": off, "prior": prior, "parent": parent, "corr": cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))}


def _counts(lists: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The weight of the rows that have each feature; some hundred rows at a time, so that arrays stay small."""
    out = np.zeros(1 << BITS)
    for i in range(0, len(lists), 256):
        part = lists[i : i + 256]
        out += np.bincount(np.concatenate(part), np.repeat(weight[i : i + 256], [len(x) for x in part]), 1 << BITS)
    return out


def _association(lists: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature, the likelihood-ratio statistic against (soft) labels y, and whether it speaks for label 1."""
    n, on, df = np.array([len(lists) - y.sum(), y.sum()]), _counts(lists, y), _counts(lists, np.ones(len(lists)))
    seen = np.array([df - on, on])
    both = df / n.sum()
    with np.errstate(all="ignore"):
        g = sum(np.nan_to_num(o * np.log(o / (n[c] * p))) for c in (0, 1) for o, p in ((seen[c], both), (n[c] - seen[c], 1 - both)))
    return 2 * g, seen[1] / n[1] > seen[0] / n[0]


def _patterns(lists: list[np.ndarray], y: np.ndarray, most: int = 200, least: float = 20.0, lift: float = 20.0) -> np.ndarray:
    """Features that mark label 1: by their likelihood-ratio statistic, among those `lift` times as frequent there."""
    g, _ = _association(lists, y.astype(float))
    on, off = (_counts(lists, (y == c).astype(float)) / (y == c).sum() for c in (1, 0))
    gain = np.where((on >= lift * off) & (g >= least), g, 0)
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def supervise(lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[int], dict]:
    """The voters (features) and the label model fitted on their votes. y: 0, 1, or -1 for an unlabelled row."""
    known = np.flatnonzero(y >= 0)
    found = _patterns([lists[i] for i in known], y[known])
    voters = list(dict.fromkeys([*(_whole(w) for w in LEXICON), *found.tolist()]))
    column = np.full(1 << BITS, -1)
    column[voters] = np.arange(len(voters))
    votes = np.zeros((len(lists), len(voters)))
    for i, x in enumerate(lists):
        votes[i, [c for c in column[x].tolist() if c >= 0]] = 1
    # a word and its first letters may be one vote: patterns that nearly equal an earlier voter go
    both, seen = votes.T @ votes, []
    for j in range(len(voters)):
        n, met = both[j, j], both[seen, j]
        if n and not (met >= 0.8 * (n + both[seen, seen] - met)).any():
            seen.append(j)
    votes = votes[:, seen]
    return [voters[i] for i in seen], label_model(votes, weight, np.where(votes.any(1), 0.9, 0.01))


def fit(sample: list[tuple[np.ndarray, int]], share: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights and intercept from (features, label) rows, label -1 where none is given; share: rows of each kind that a
    sampled row stands for."""
    lists, y = [x for x, _ in sample], np.array([v for _, v in sample], int)
    weights = np.zeros(1 << BITS, np.float32)
    if not {0, 1} <= set(y.tolist()):
        weights[[_whole(w) for w in LEXICON]] = 4.0
        return weights, -2.0
    stands = np.array([share[v] for v in y.tolist()])
    target = supervise(lists, y, stands)[1]["posterior"]
    # only features that go with the posteriors beyond chance: the others would be learnt by heart
    g, up = _association(lists, target)
    use = up & (g >= 10.0)
    some = [x[use[x]] for x in lists]
    rows = np.repeat(np.arange(len(some)), [len(x) for x in some])
    kept, col = np.unique(np.concatenate(some), return_inverse=True)
    # rows weigh by their true share, softened so that the rare class isn't drowned
    w = np.sqrt(stands)
    w /= w.sum()
    theta, bias, g2, b2 = np.zeros(len(kept)), float(np.log((w @ target + 1e-6) / (1 - w @ target + 1e-6))), np.full(len(kept), 1e-8), 1e-8
    for _ in range(300):
        z = bias + np.bincount(rows, theta[col], len(lists))
        d = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.bincount(col, d[rows], len(kept)) + 1e-5 * theta
        g2 += g * g
        b2 += d.sum() ** 2
        theta -= 0.1 * g / np.sqrt(g2)
        bias -= 0.1 * d.sum() / np.sqrt(b2)
    weights[kept] = theta
    return weights, bias


def _whole(word: str) -> int:
    return int((words(word.encode())[2] ^ np.uint64(1))[0] >> np.uint64(64 - BITS))


def held_out(id_column, folds: int = 5):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fitting_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, folds: int = 5) -> tuple[list[tuple[np.ndarray, int]], dict[int, float]]:
    """(features, label or -1) of the rows of the fit, and how many rows each kind of them stands for."""
    lean(docs.sparkSession)
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).filter(~held_out(F.col("id"), folds))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    counts = {0: 0, 1: 0} | {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    if not counts[0] or not counts[1]:
        return [], {}
    least = [F.xxhash64("id"), F.col("id")]
    labelled = [given.filter(F.col("y") == y).orderBy(*least).limit(per_class) for y in (0, 1)]
    # of the least ids of all documents, those without a label
    some = named.select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(per_class).distinct()
    every = named.agg(F.count("*").alias("n")).first()["n"]
    other = some.join(F.broadcast(labels.select(F.col(id_col).cast("long").alias("id")).join(F.broadcast(some), "id", "left_semi").distinct()), "id", "left_anti")
    chosen = labelled[0].unionByName(labelled[1]).unionByName(other.select("id", F.lit(-1).alias("y")))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [features(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in lists], pa.binary()), batch.column(2)], ["id", "f", "y"])

    one = named.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), F.col("text"), F.col("y"))).alias("r"))
    rows = one.select("id", "r.text", "r.y").mapInArrow(run, "id long, f binary, y int").toArrow().sort_by("id")  # 3 * per_class rows at most
    sample = [(np.frombuffer(f.as_buffer(), np.int32), y.as_py()) for f, y in zip(rows.column("f"), rows.column("y"))]
    found = {v: sum(y == v for _, y in sample) for v in (-1, 0, 1)}
    counts[-1] = max(0, every - counts[0] - counts[1])
    return sample, {v: max(1.0, counts[v] / max(1, found[v])) for v in (-1, 0, 1)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, folds: int = 5) -> tuple[np.ndarray, float]:
    """The classifier, from rows outside the held-out fold, per_class of each kind at most."""
    return fit(*fitting_rows(docs, labels, id_col, text_col, label_col, per_class, folds))


def _scores(texts: pa.Array, w: np.ndarray, bias: float) -> np.ndarray:
    z = np.array([bias + float(w[features(t)].sum(dtype=np.float64)) for t in utf8(texts)])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text."""
    shipped, bias = lean(docs.sparkSession).sparkContext.broadcast(model[0]), model[1]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), w, bias), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose own text scores the threshold or more, whatever their id; all columns stay."""
    w, bias = train(docs, labels, id_col, text_col)
    shipped, at = lean(docs.sparkSession).sparkContext.broadcast(w), docs.columns.index(text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), w, bias) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
