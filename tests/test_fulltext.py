"""Full-text search: the index, the rank by its formula, and stored queries."""

import math
import random

import pytest

from skein.operators import fulltext as T


def brute(docs, query, stemmer="porter", weights=(0.1, 0.1), k=10):
    """The rank by its definition, one document at a time."""
    stem, wanted, out = T.STEMMERS[stemmer], T.query_terms(query, stemmer), []
    for i, title, text in docs:
        places, at = {}, 0
        for w, part in zip(weights, (title, text)):
            for word in T._WORD.findall((part or "").lower()):
                at += 1
                if word not in T.STOP:
                    places.setdefault(stem(word), []).append((min(at, T.LAST), w))
        if not wanted or any(w not in places for w in wanted):
            continue
        places = {t: p[: T.MOST] for t, p in places.items()}
        if len(wanted) == 1:
            p = [w for _, w in places[wanted[0]]]
            best = max(p)
            rank = (best + sum(w / (j * j) for j, w in enumerate(p, 1)) - best / (p.index(best) + 1) ** 2) / 1.64493406685
        else:
            left = 1.0
            for x in range(len(wanted)):
                for y in range(x):
                    for p, v in places[wanted[x]]:
                        for q, w in places[wanted[y]]:
                            if p != q:
                                near = 1e-30 if abs(p - q) > 100 else 1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2))
                                left *= 1 - math.sqrt(v * w * near)
            rank = max(1e-20, 1 - left)
        out.append((-round(rank, 9), i))
    return [(i, -r) for r, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = "river rivers running runner run bridge Bridges the of and stone stones city cities öre".split()
    docs = [(i, f"{rng.choice(words)} {i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    return [*docs, (80, None, "river bridge"), (81, "river", None), (82, "", ""), (83, "Stone. Stone", "stone " * 400 + "bridge")]


def frame(spark, corpus):
    return spark.createDataFrame(corpus, "doc_idx long, title string, raw_text string")


@pytest.mark.parametrize("query", ["river", "rivers of the bridge", "running stones cities", "öre Runner", "the of", "absent river", "bridge bridge"])
@pytest.mark.parametrize("stemmer", ["porter", "plural"])
def test_rank_equals_its_definition(spark, corpus, query, stemmer):
    got = [(r.doc_idx, r["rank"]) for r in T.search(frame(spark, corpus), query, 10, stemmer).collect()]
    want = brute(corpus, query, stemmer)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 2e-9 for (_, a), (_, b) in zip(got, want))


def test_title_counts_more_with_weights(spark, corpus):
    got = [(r.doc_idx, round(r["rank"], 8)) for r in T.search(frame(spark, corpus), "river bridge", 10, weights=(1.0, 0.1)).collect()]
    want = brute(corpus, "river bridge", weights=(1.0, 0.1))
    assert [i for i, _ in got] == [i for i, _ in want]
    one = [(r.doc_idx, round(r["rank"], 8)) for r in T.search(frame(spark, corpus), "stone", 5, weights=(1.0, 0.1)).collect()]
    assert one == [(i, round(r, 8)) for i, r in brute(corpus, "stone", weights=(1.0, 0.1), k=5)]


def test_stored_index_gives_the_same_and_reads_its_terms(spark, corpus, tmp_path):
    docs = frame(spark, corpus)
    T.store(T.build(docs), str(tmp_path / "index"))
    stored = T.Stored(spark, str(tmp_path / "index"))
    got = stored.search("the rivers' bridges", 10, docs.select("doc_idx", "title"))
    assert [r.doc_idx for r in got.collect()] == [i for i, _ in brute(corpus, "river bridge")]
    assert got.columns == ["doc_idx", "rank", "title"]
    assert "PushedFilters: [In(term, [bridg,river])]" in stored.postings.filter("term in ('bridg', 'river')")._jdf.queryExecution().executedPlan().toString()
    # places are counted over stop words too
    row = T.build(spark.createDataFrame([(1, "A river", "of the rivers")], "doc_idx long, title string, raw_text string")).collect()
    assert [(r.term, r.places) for r in row] == [("river", [2, 5])]


def test_empty_corpus_and_matches(spark, corpus):
    docs = frame(spark, corpus)
    assert T.search(docs.limit(0), "river").collect() == []
    found = {r.doc_idx for r in docs.filter(T.matches("rivers bridges", docs.raw_text)).collect()}
    assert found == {i for i, _, t in corpus if t and {"river", "bridg"} <= {x for _, x in T.terms(t, T.porter, frozenset(T.STOP))}}
    assert docs.filter(T.matches("the", docs.raw_text)).count() == 0


def test_plurals():
    assert [T.plural(w) for w in ("cities", "stones", "glass", "bus", "shoes", "trees", "river", "eies")] == ["city", "stone", "glass", "bus", "shoes", "trees", "river", "eies"]
