"""Lemmas: planted pairs, the vocabulary's say, and token arrays."""

from skein.functions import lemma

PAIRS = {
    "rivers": "river", "cities": "city", "boxes": "box", "churches": "church", "dishes": "dish", "firemen": "fireman", "wolves": "wolf",
    "baked": "bake", "walked": "walk", "baking": "bake", "walking": "walk", "larger": "large", "largest": "large", "colder": "cold",
    "children": "child", "went": "go", "better": "good", "was": "be", "glass": "glass", "under": "under", "sing": "sing", "bus": "bus",
}


def test_planted_pairs(spark):
    words = spark.createDataFrame([(w,) for w in {*PAIRS, *PAIRS.values()}] + [(None,), ("",)], "term string")
    got = {r.term: r.lemma for r in lemma.lemma_table(words).collect()}
    assert got == {k: v for k, v in PAIRS.items() if k != v} | {k: v for k, v in lemma.IRREGULAR.items() if k in {*PAIRS.values()}}


def test_the_vocabulary_decides(spark):
    words = spark.createDataFrame([("hoping",), ("hopes",), ("nothings",)], "term string")
    assert lemma.lemma_table(words).collect() == []
    for known, want in (("hope", {"hoping": "hope", "hopes": "hope"}), ("hop", {"hoping": "hop", "hopes": "hop"})):
        vocabulary = spark.createDataFrame([(known,)], "term string")
        assert {r.term: r.lemma for r in lemma.lemma_table(words, vocabulary).collect()} == want


def test_counts_and_tokens(spark):
    table = spark.createDataFrame([("rivers", "river"), ("went", "go")], "term string, lemma string")
    counts = spark.createDataFrame([(1, "river", 2), (1, "rivers", 3), (2, "went", 1), (2, "sea", 4)], "cluster_id int, term string, n long")
    assert sorted(map(tuple, lemma.lemmatized_counts(counts, table, ["cluster_id"]).collect())) == [(1, "river", 5), (2, "go", 1), (2, "sea", 4)]
    docs = spark.createDataFrame([(1, ["rivers", "went", "rivers"]), (2, []), (3, None), (4, ["sea"])], "doc_idx long, tokens array<string>")
    got = {r.doc_idx: r.tokens for r in lemma.lemmatized(docs, table).collect()}
    assert got == {1: ["river", "go", "river"], 2: [], 3: None, 4: ["sea"]}
