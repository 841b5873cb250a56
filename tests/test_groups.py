"""Tables that change together, and ingestion that counts what it keeps."""

import json
import os

import pytest
from py4j.protocol import Py4JJavaError

from skein import streaming
from skein.operators import tables


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_group_is_committed_or_rolled_back(spark, tmp_path):
    folder = str(tmp_path / "g")
    with tables.Group(spark, folder) as g:
        g.write("a", spark.range(3))
        g.write("b", spark.range(2))
        with pytest.raises(KeyError):
            tables.Group(spark, folder).read("a")
    now = tables.Group(spark, folder)
    assert ids(now.read("a")) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        with tables.Group(spark, folder) as g:
            g.write("a", spark.range(9))
            raise ZeroDivisionError
    assert ids(now.read("a")) == [0, 1, 2] and len([f for f in os.listdir(folder) if f != "_commits"]) == 1
    with tables.Group(spark, folder) as g:
        g.write("b", now.read("b").filter("id > 0"))
    assert ids(now.read("b")) == [1] and ids(now.read("a")) == [0, 1, 2]


def test_of_two_blocks_that_began_alike_the_second_fails(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(Py4JJavaError):
        with tables.Group(spark, folder) as one:
            one.write("a", spark.range(1))
            with tables.Group(spark, folder) as two:
                two.write("a", spark.range(5))
    assert ids(tables.Group(spark, folder).read("a")) == list(range(5))


def test_ingestion_counts_what_it_keeps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [json.dumps({"id": 10 * k + i, "text": "x" * i}) for i in range(10)]
        (tmp_path / f"in/{k}.json").write_text("\n".join(rows))
        os.utime(tmp_path / f"in/{k}.json", (1000 + k, 1000 + k))
    target = str(tmp_path / "out")
    for _ in range(2):
        streaming.ingest_kept(spark, str(tmp_path / "in"), "id long, text string", target, str(tmp_path / "cp"), lambda b: b.filter("length(text) >= 4"), 5, 1).awaitTermination()
    got = [tuple(spark.read.parquet(f"{target}/checkpoints/{k}").first()) for k in range(3)]
    assert got == [(0, 6, 6, 1), (1, 6, 12, 2), (2, 6, 18, 3)]
    kept = spark.read.parquet(f"{target}/articles")
    assert ids(kept) == [10 * k + i for k in range(3) for i in range(4, 10)]
    assert all(sum(f.endswith(".parquet") for f in os.listdir(f"{target}/articles/batch={k}")) == 2 for k in range(3))
