"""Traces as streams: running hits, windows with late data, call depth with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..operators.sequence import step
from ..shipping import ship


def read_trace(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """A folder of JSON-lines traces as a stream, with event time ts."""
    rows = spark.readStream.schema(schemas.TRACE).option("maxFilesPerTrigger", files_a_trigger).json(path)
    return rows.withColumn("ts", F.to_timestamp("timestamp"))


def node_hits(trace: DataFrame) -> DataFrame:
    """Running call counts a node (output mode complete or update)."""
    node = F.coalesce(F.nullif("callee_node_id", F.lit("")), F.nullif("node", F.lit("")))
    return trace.where("event = 'call'").groupBy(node.alias("node_id")).agg(F.count("*").alias("hits"))


def windowed_hits(trace: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Calls a window; rows later than the watermark are left out."""
    return trace.where("event = 'call'").withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("calls"), F.approx_count_distinct("callee_node_id").alias("nodes")).select("window.start", "window.end", "calls", "nodes")


def run_sessions(trace: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each run, cut at gaps."""
    return trace.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("run_id", "w.start", "w.end", "events")


#: The state store that transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CallStack(StatefulProcessor):
    """A run's stack of calls.  Rows wait in the state until the watermark has passed them, so
    that whatever order they come in, they are taken by their number; event-time timers release
    them, and end a run that has been idle for long enough."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, at long, event string, node_id string")
        self.stack = handle.getValueState("stack", "nodes array<string>, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        new = [tuple(r) for frame in rows for r in zip(frame["seq"].tolist(), frame["at"].tolist(), frame["event"], frame["node_id"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[1] for r in new))
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        yield from self._released(key, timerValues.getCurrentWatermarkInMs())

    def _released(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[1] <= watermark), key=lambda r: r[0])
        state = self.stack.get() if self.stack.exists() else None
        stack, last = (list(state[0] or []), state[1]) if state else ([], None)
        out = []
        for seq, at, event, node in ready:
            if last is not None and at - last > self.idle_ms:
                stack = []
            last = at
            depth = step(stack, event, node)
            if depth is not None:
                out.append((key[0], seq, node, depth))
        if ready:
            later = [tuple(r) for r in rows if r[1] > watermark]
            self.waiting.put(later) if later else self.waiting.clear()
        if last is not None and watermark - last > self.idle_ms or not stack:
            self.stack.clear()
        elif ready:
            self.stack.update((stack, last))
            self.handle.registerTimer(last + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "node_id", "depth"])

    def close(self) -> None:
        pass


def call_depth(trace: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Call depth of each call row, as sequence.call_stacks gives it for the whole trace.

    trace: run_id, seq, event, node (or callee_node_id), and the event time ts, which does not
    fall with seq within a run.  Rows later than the watermark are left out.  A stack that has
    seen no event for idle_ms of event time is empty again; nothing depends on when a row was
    processed, so micro-batches in any order, and restarts, give the same depths.
    """
    spark = trace.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    node = F.coalesce(F.nullif("callee_node_id", F.lit("")), F.nullif("node", F.lit("")))
    rows = trace.withWatermark("ts", late).where("ts is not null and run_id is not null").select("run_id", "seq", F.unix_millis("ts").alias("at"), "event", node.alias("node_id"), "ts")
    return rows.groupBy("run_id").transformWithStateInPandas(CallStack(idle_ms), "run_id string, seq long, node_id string, depth long", "append", "EventTime")
