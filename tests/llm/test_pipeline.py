"""The stages of the corpus pipeline, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = P.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        docs = P.written(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        if name in ("toxicity", "minhash_dedup"):
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert seen[0] < 1000 and seen[0] == seen[1] and seen[2] <= seen[1] and seen[4] == seen[3]
    assert P.run(spark, SF).count() == seen[-1]


def test_stages_take_nulls_repeats_long_texts_and_empty_tables(spark):
    words = [f"w{i}" for i in range(200)]
    base, long = " ".join(words), "\n".join(" ".join(f"l{i}x{j}" for j in range(9)) for i in range(6000))
    rows = [(1, base, "en", "s", 1), (2, base + " more", "en", "s", 1), (2, "two\nlines", "en", None, 1), (3, None, None, None, None), (4, "", "en", "s", 1), (None, base, "en", "s", 1), (5, long, "fr", "t", 1), (1, base, "en", "s", 1), (6, "  \n\t", None, "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).withColumns({"size": F.lit("x"), "kept": F.lit(1), "gone": F.lit(2), "copies": F.lit(3)})):
        columns, n = docs.columns, docs.count()
        for name, stage in P.STAGES:
            docs = P.written(stage(spark, docs, SF), name)
            if name != "byte_bpe":
                assert docs.columns == columns
            if name == "toxicity":
                assert docs.count() == n  # none of these is toxic
            if name == "line_dedup":
                assert docs.count() == n and (not n or docs.filter("doc_id = 5").first().text == long)
            if name == "minhash_dedup" and n:
                # the null id orders first, so its line stays and documents 1 and 2 lose theirs
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())[-1] == (True, 0)
                assert docs.filter("doc_id = 5").count() == 1
        assert docs.columns[:2] == ["doc_id", "n_tokens"] and (n > 0) == (docs.count() > 0)


def test_stages_hand_small_batches_to_python(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "16m")
        docs = P.table(spark, SF, "documents").limit(20)
        for name, stage in P.STAGES[1:]:
            out = stage(spark, docs, SF)
            assert spark.conf.get(key) == "4m", name
        # one worker a task encodes and decodes
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    finally:
        spark.conf.set(key, before)


def test_blobs_of_lines_are_sent_in_small_batches():
    rows = [(i, bytes([i]) * 700_000) for i in range(10)]
    batches = list(P.linededup._sent(["p", "rec"], (P.linededup.pa.int32(), P.linededup.pa.binary()), iter(rows)))
    assert [b.num_rows for b in batches] == [3, 3, 3, 1]
    assert [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))] == rows
