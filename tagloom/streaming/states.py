"""Stateful stream processors: quiet periods closed by timers, and rolling tails of logs."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The driver starts processors once in a Python of its own that doesn't get the files sent to the
# executors, so they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Lines of a log that are kept, and what a line with progress looks like.
TAIL = 60
PROGRESS = re.compile(r"(?:paso|step)\s+([0-9]+)", re.I)


class QuietPeriod(StatefulProcessor):
    """One open session a key: newer writes within the gap extend it, a later write closes it, and so does a timer when nothing more came.

    The timer is in processing time and set anew with every write, so a key's last session is
    emitted too.  A write that is older than the open session by the gap or more is a session of
    its own.
    """

    def __init__(self, key: str, gap_ms: int, quiet_ms: int):
        self.key, self.gap, self.quiet = key, pd.Timedelta(milliseconds=gap_ms), quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first timestamp, last timestamp, writes long")

    def _rows(self, key, sessions: list) -> pd.DataFrame:
        return pd.DataFrame([(key, *s) for s in sessions], columns=[self.key, "first", "last", "writes"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.session.get()) if self.session.exists() else None
        closed = []
        for ts in pd.concat([part["ts"] for part in rows]).sort_values():
            if now is None:
                now = (ts, ts, 1)
            elif ts - now[1] >= self.gap:
                closed.append(now)
                now = (ts, ts, 1)
            elif now[0] - ts >= self.gap:
                closed.append((ts, ts, 1))
            else:
                now = (min(now[0], ts), max(now[1], ts), now[2] + 1)
        self.session.update(now)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        if closed:
            yield self._rows(key[0], closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            last = tuple(self.session.get())
            self.session.clear()
            yield self._rows(key[0], [last])

    def close(self) -> None:
        pass


class LogTail(StatefulProcessor):
    """The last lines of each job's log as a list state, its latest step and its number of lines; a row a job and batch."""

    def __init__(self, lines: int):
        self.most = lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "no long, line string")
        self.told = handle.getValueState("told", "seen long, step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, step = tuple(self.told.get()) if self.told.exists() else (0, None)
        new = pd.concat([part[["no", "line"]] for part in rows]).sort_values("no", kind="stable")
        for line in new["line"]:
            found = PROGRESS.search(line or "")
            step = int(found[1]) if found and len(found[1]) < 19 else step
        tail = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        tail = (tail + list(new.itertuples(index=False, name=None)))[-self.most :]
        self.lines.put([(int(no), line) for no, line in tail])
        self.told.update((seen + len(new), step))
        yield pd.DataFrame({"job": [key[0]], "seen": [seen + len(new)], "step": pd.array([step], "Int64"), "tail": ["\n".join(line or "" for _, line in tail)]})

    def close(self) -> None:
        pass


def quiet_sessions(events: DataFrame, key: str, ts: str, gap_ms: int, quiet_ms: int) -> DataFrame:
    """(key, first, last, writes) of a stream's sessions, the open ones after quiet_ms without a write; see QuietPeriod."""
    kind = events.schema[key].dataType.simpleString()
    own = events.select(key, events[ts].cast("timestamp").alias("ts")).where("ts is not null")
    return own.groupBy(key).transformWithStateInPandas(QuietPeriod(key, gap_ms, quiet_ms), f"`{key}` {kind}, first timestamp, last timestamp, writes long", "append", "processingTime")


def log_tails(lines: DataFrame, most: int = TAIL) -> DataFrame:
    """(job, seen, step, tail) of a stream of log lines (job, no, line): a row a job and batch, the one with most seen is the newest."""
    kind = lines.schema["job"].dataType.simpleString()
    return lines.select("job", "no", "line").groupBy("job").transformWithStateInPandas(LogTail(most), f"job {kind}, seen long, step long, tail string", "append", "none")


def with_rocks(spark: SparkSession, run: Callable[[], None]) -> None:
    """Run with the state store that processors of this kind need; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        run()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def to_table(out: DataFrame, path: str, checkpoint: str, quiet_ms: int | None = None, wait_s: float = 600) -> None:
    """Write a stream's rows to a table until it has taken all that is there; with quiet_ms also until its timers have run.

    Processing-time timers run in batches without data, which an available-now trigger never
    ends; so the query ticks until a batch has begun that much later than the last data.
    """

    def run() -> None:
        writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        if quiet_ms is None:
            writer.trigger(availableNow=True).start().awaitTermination()
            return
        query = writer.trigger(processingTime="500 milliseconds").start()
        due, until = None, time.time() + wait_s
        try:
            while query.isActive and time.time() < until:
                done = query.lastProgress
                if done and done["numInputRows"] == 0:  # all that was there has been taken
                    due = due or time.time() + quiet_ms / 1000 + 1
                    if pd.Timestamp(done["timestamp"]).timestamp() > due:
                        return
                time.sleep(0.2)
            raise query.exception() or TimeoutError("the timers of the stream didn't run in time")
        finally:
            query.stop()

    with_rocks(out.sparkSession, run)
