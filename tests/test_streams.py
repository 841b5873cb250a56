"""The progress feed, the log sink and bounded retention."""

import datetime
import glob
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import streaming
from skein.streaming import feed, sink

POLLS = "run_id string, timestamp timestamp, current_stage string, stages array<struct<name:string,status:string,progress:double>>"
START = datetime.datetime(2024, 1, 1)


def poll(run, second, state, done=False):
    return {"run_id": run, "timestamp": (START + datetime.timedelta(seconds=second)).isoformat(), "current_stage": None if done else "s", "stages": [{"name": state, "status": "completed" if done else "running", "progress": 0.5}]}


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))


def told(rows):
    return sorted((r.run_id, r.timestamp.second + 60 * r.timestamp.minute, r.event, json.loads(r.data)["stages"][0]["name"] if r.event == "data" else None) for r in rows)


def want(run):
    # A, A, B, A, then quiet: the poll of the change counts, so the thirtieth is the 29th after it
    events = [(0, "data", "A"), (2, "data", "B"), (3, "data", "A"), (32, "keep-alive", None), (44, "data", "A!"), (44, "reload", None), (44, "data", "A!"), (44, "close", None)]
    return sorted((run, at, e, n) for at, e, n in events)


def run_of(run):
    rows = [poll(run, i, s) for i, s in enumerate("AABA")] + [poll(run, i, "A") for i in range(4, 44)]
    return [*rows, poll(run, 44, "A!", True), poll(run, 45, "A!", True)]


@pytest.mark.parametrize("per", [1, 7, 46])
def test_feed_of_a_stream(spark, tmp_path, per):
    rows = run_of("r")
    for k in range(0, len(rows), per):
        put(tmp_path / "in", k, rows[k : k + per])
    if per == 1:
        rows = rows[:10]  # a batch a poll, of the first ones
        for f in glob.glob(str(tmp_path / "in/*.json")):
            if int(os.path.basename(f)[:-5]) >= 10:
                os.remove(f)
    stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = streaming.run_to_table(feed.progress_feed(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert told(out.collect()) == [w for w in want("r") if w[1] < 10 or per > 1]


def test_feed_of_a_frame_is_the_same(spark, tmp_path):
    put(tmp_path / "in", 0, run_of("r") + run_of("q"))
    out = feed.progress_feed(spark.read.schema(POLLS).json(str(tmp_path / "in")))
    assert told(out.collect()) == sorted(want("r") + want("q"))


def test_a_closed_feed_opens_again_and_idle_state_is_freed(spark, tmp_path):
    events, kept = feed.events_of([(0, "x", True), (1, "x", True), (2, "y", False)], None, 0, False)
    assert [e for _, e, _ in events] == ["data", "reload", "data", "close", "data"] and kept == ("y", 1, False)
    # r is polled again two hours later: by then its state is gone, so the same state is data once more
    put(tmp_path / "in", 0, [poll("r", 0, "A"), poll("q", 0, "A")])
    put(tmp_path / "in", 1, [poll("q", 7000, "B")])
    put(tmp_path / "in", 2, [poll("q", 7100, "C")])
    put(tmp_path / "in", 3, [poll("r", 7200, "A")])
    stream = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = streaming.run_to_table(feed.progress_feed(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.event for r in out.filter("run_id = 'r'").collect()] == ["data", "data"]


def batches(*values):
    for v in values:
        if isinstance(v, Exception):
            raise v
        yield pa.RecordBatch.from_pydict({"line": v})


def test_a_task_that_is_tried_again_leaves_each_line_once(spark, tmp_path):
    w = sink.StreamWriter(str(tmp_path / "log"), None, "s")
    with pytest.raises(OSError, match="lost"):
        w.write(batches(["a", "b"], OSError("lost")))
    first = w.write(batches(["a", "b"], ["c"]))
    other = w.write(batches(["d"]))
    w.commit([first, None, other, w.write(batches())], 0)
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list("abcd")
    # the same batch again, from one task now
    w.commit([w.write(batches(list("abcd")))], 0)
    gone = w.write(batches(["never"]))
    w.abort([gone, None], 1)
    w.commit([w.write(batches(["e"]))], 1)
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list("abcde")


def test_log_table_of_frames_and_streams(spark, tmp_path):
    target = str(tmp_path / "log")
    streaming.append_logs(spark.range(5).select(F.col("id").cast("string").alias("value")).repartition(3), target)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.log").write_text(f"x{k}\ny{k}\n")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    for _ in range(2):
        streaming.stream_logs(stream, target, str(tmp_path / "cp")).awaitTermination()
    lines = sorted(r.value for r in spark.read.parquet(target).collect())
    assert lines == sorted([*map(str, range(5)), *(f"{c}{k}" for c in "xy" for k in range(3))])
    sink.register(spark)
    spark.range(1).select(F.lit("only").alias("value")).write.format("loglines").mode("overwrite").save(target)
    assert [r.value for r in spark.read.parquet(target).collect()] == ["only"]


def test_retention_stays_bounded_over_many_batches(spark, tmp_path):
    for k in range(50):
        put(tmp_path / "in", k, [{"id": 10 * k + i, "timestamp": 10 * k + i} for i in range(10)])
    stream = spark.readStream.schema("id long, timestamp long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    streaming.retain(stream, str(tmp_path / "kept"), str(tmp_path / "cp"), 25).awaitTermination()
    versions = sorted(os.listdir(tmp_path / "kept"), key=int)
    assert versions == ["48", "49"]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept/49")).collect()) == list(range(475, 500))


def test_newest_rows_of_each_key(spark, tmp_path):
    for k in range(4):
        put(tmp_path / "in", k, [{"endpoint": e, "timestamp": 10 * k + i} for i in range(10) for e in ("a", "b")[: 1 + (k < 2)]])
    stream = spark.readStream.schema("endpoint string, timestamp long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    q = streaming.newest_by_key(stream, "endpoint", 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, _: got.append(sorted(map(tuple, b.collect())))).start()
    q.awaitTermination()
    assert got[1] == [(e, t) for e in "ab" for t in (17, 18, 19)] and got[3] == [("a", t) for t in (37, 38, 39)]
