"""Files that have been quiet for long enough, and bursts of changes, as streams and as batches."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.classify import any_of
from ..operators.findings import glob

IDLE = "project string, path string, last timestamp"


def wanted(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """By the globs of the base name."""
    name = F.substring_index(path, "/", -1)
    return any_of(F.lit(False), *(name.rlike(glob(p)) for p in include)) & ~any_of(F.lit(False), *(name.rlike(glob(p)) for p in exclude))


def changes(events: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Creations and writes of files whose names are included and not excluded; works on streams and on batches."""
    return events.where(F.col("op").isin("create", "write") & wanted(F.col("path"), include, exclude))


def fan_in(*streams: DataFrame) -> DataFrame:
    """One stream of several projects' ones."""
    first, *rest = streams
    for s in rest:
        first = first.unionByName(s)
    return first


def configured(events: DataFrame, config: DataFrame, default_seconds: int = 300) -> DataFrame:
    """Events of enabled projects, with each one's timeout in seconds. The static side is read anew for each micro-batch of a stream
    that is written by foreachBatch."""
    return events.join(config.where("enabled").select("project", "idle_seconds"), "project").withColumn("idle_seconds", F.coalesce("idle_seconds", F.lit(default_seconds)))


def idle_batch(events: DataFrame, seconds: int = 300, now: Column | None = None) -> DataFrame:
    """(project, path, last): keys whose last change is at least so long before now, by default the last event of all. A key's
    last change is its greatest time, also if events come out of order."""
    last = events.groupBy("project", "path").agg(F.max("ts").alias("last"))
    ref = now if now is not None else events.agg(F.max("ts")).scalar()
    return last.where(ref.cast("timestamp") >= F.col("last").cast("timestamp") + F.expr(f"interval {int(seconds)} seconds"))


def idle_stream(events: DataFrame, seconds: int = 300, delay: str = "0 seconds") -> DataFrame:
    """idle_batch() for a stream with event times ts: each quiet key once, when the watermark has passed its last change by the timeout.
    A key that a gone or finished event (op) names is forgotten; the newest key stays until the watermark moves on."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"project": [key[0]], "path": [key[1]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else -1
        gone = False
        for batch in batches:
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            last = max(last, int(times.max()))
            gone |= "op" in batch and bool(batch["op"].isin(["gone", "done"]).any())
        if gone:
            if state.exists:
                state.remove()
            return
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("project", "path").applyInPandasWithState(advance, IDLE, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def bursts(events: DataFrame, gap: str = "100 milliseconds", keys: tuple[str, ...] = ("path",), delay: str | None = None) -> DataFrame:
    """(keys, first, until, n): runs of changes with less than the gap between them; with a delay on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay else timed
    return timed.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def survivors(tracked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Keys that stay tracked after a round: those that failed, timed out or were open, and those without an outcome (project, path, outcome)."""
    done = outcomes.where(F.col("outcome").isin("encrypted", "already_encrypted", "missing"))
    return tracked.join(done, ["project", "path"], "left_anti")


class Rounds:
    """Calls of an action on a thread of its own, one at a time. A call while one is running is skipped and not queued, so whoever calls,
    such as a stream, never waits for a slow round."""

    def __init__(self, action: Callable):
        self.action, self.thread, self.failed = action, None, None

    def __call__(self, *args) -> bool:
        """Whether a round has been started."""
        if self.thread is not None and self.thread.is_alive():
            return False
        self.thread = threading.Thread(target=self._run, args=args, daemon=True)
        self.thread.start()
        return True

    def _run(self, *args) -> None:
        try:
            self.action(*args)
        except Exception as e:  # kept for whoever waits; the next round starts all the same
            self.failed = e

    def wait(self, seconds: float | None = None) -> None:
        if self.thread is not None:
            self.thread.join(seconds)
        if self.failed is not None:
            failed, self.failed = self.failed, None
            raise failed


def follow(events: DataFrame, registry: Callable[[], DataFrame], tick: Callable[[DataFrame], object], default_seconds: int = 300) -> DataStreamWriter:
    """A writer that gives each micro-batch's events of the projects that are enabled by then to tick. The registry (project, enabled,
    idle_seconds) is read anew for each batch, so projects come and go while the stream runs."""
    return events.writeStream.foreachBatch(lambda batch, _: tick(configured(batch, registry(), default_seconds)) and None)
