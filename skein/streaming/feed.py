"""The progress feed of runs as a stream: changes, keep-alives, and the end of a run; state that is freed.

Polls (run_id, timestamp, current_stage, stages: array of name, status, progress) become events (run_id, timestamp, event,
data). A poll whose state differs from the one before is `data`; the KEEP_ALIVE-th poll since the last event is a
`keep-alive` (the poll of a change counts as one); when no stage is current and every stage is completed or failed, the
feed says `reload`, hands on the last state once more and closes. Polls of a closed feed that repeat its last state are
passed over; another state opens it again.

A run's state is its last state, a counter and whether it is closed. A timer by event time frees it when the run hasn't been
polled for `idle`, so that the state holds the runs of that time only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP_ALIVE = 30
EVENTS = "run_id string, timestamp timestamp, event string, data string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_of(polls: list[tuple], last: str | None, quiet: int, closed: bool) -> tuple[list[tuple], tuple[str | None, int, bool]]:
    """Events (timestamp, event, data) of polls (timestamp, state, done) in order, and what is kept."""
    out = []
    for at, state, done in polls:
        if closed and state == last:
            continue
        closed = False
        if state != last:
            out.append((at, "data", state))
            last, quiet = state, 0
        quiet += 1
        if quiet >= KEEP_ALIVE:
            out.append((at, "keep-alive", None))
            quiet = 0
        if done:
            out += [(at, "reload", json.dumps({"type": "reload", "status": "starting"})), (at, "data", state), (at, "close", None)]
            closed = True
    return out, (last, quiet, closed)


class _Feed(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last string, quiet int, closed boolean, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        polls = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        last, quiet, closed, timer = self.run.get() if self.run.exists() else (None, 0, False, None)
        out, kept = events_of(list(zip(polls["timestamp"], polls["state"], polls["done"])), last, quiet, closed)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(int(polls["timestamp"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle
        self.handle.registerTimer(timer)
        self.run.update((*kept, timer))
        if out:
            yield pd.DataFrame([(key[0], *e) for e in out], columns=["run_id", "timestamp", "event", "data"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.run.clear()
        yield from ()

    def close(self) -> None:
        pass


def polled(polls: DataFrame) -> DataFrame:
    """run_id, timestamp, state (JSON of the current stage and the stages) and done."""
    ended = F.col("current_stage").isNull() & F.coalesce(F.forall("stages", lambda s: s["status"].isin("completed", "error")), F.lit(True))
    state = F.to_json(F.struct("current_stage", "stages"), {"ignoreNullFields": "false"})
    return polls.select("run_id", F.col("timestamp").cast("timestamp").alias("timestamp"), state.alias("state"), ended.alias("done"))


def progress_feed(polls: DataFrame, idle: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """The events of a stream of polls; of a frame, the same over each run's polls in order of time.

    A stream needs the RocksDB state store, which is set for the session.
    """
    rows = polled(polls)
    if not polls.isStreaming:
        def whole(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("timestamp", kind="stable")
            out, _ = events_of(list(zip(g["timestamp"], g["state"], g["done"])), None, 0, False)
            return pd.DataFrame([(g["run_id"].iloc[0], *e) for e in out], columns=["run_id", "timestamp", "event", "data"])

        return rows.groupBy("run_id").applyInPandas(whole, EVENTS)
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withWatermark("timestamp", late).groupBy("run_id").transformWithStateInPandas(_Feed(idle_ms), EVENTS, "Append", "EventTime")
