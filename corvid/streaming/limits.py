"""Sliding-window-log rate limits: each request is allowed if fewer than ``limit`` *allowed* ones are in the window before it.

A decision depends on the decisions before it, so the requests of a key are taken in order; what is kept of a key is its
allowed times within the window, at most ``limit`` of them. The batch form cuts keys at pauses of a window or more, after
which nothing is remembered, so that one busy key is spread over tasks wherever it pauses. The stream form keeps the log as
list state and drops it by an event-time timer once the watermark has passed the window of its newest entry.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Shortest time that a refused request is told to wait, in microseconds.
LEAST_WAIT = 1_000_000


def decide(log: deque[int], at: int, limit: int, window: int) -> int | None:
    """None if a request at ``at`` is allowed (and logged), else how long it has to wait; times in microseconds."""
    while log and log[0] <= at - window:
        log.popleft()
    if len(log) >= limit:
        return max(LEAST_WAIT, log[0] + window - at) if log else window
    log.append(at)
    return None


def limit_decisions(events: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """``key, tie, allowed, wait_us`` of every event with a time, in order of (time, ``tie``) within its key.

    Null keys are one key; events without a time are left out; repeated rows are requests of their own.
    """
    window = seconds * 1_000_000
    own = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).alias("tie")).where("at is not null")
    own = own.withColumn("slot", F.floor(F.col("at") / window))
    # two events with an empty slot between them are more than a window apart; slots are counted, not events
    slots = own.groupBy("k", "slot").agg(F.count("*").alias("n"))
    before = F.lag("slot").over(Window.partitionBy("k").orderBy("slot"))
    slots = slots.withColumn("pause", F.coalesce((F.col("slot") - before > 1).cast("int"), F.lit(0)))
    slots = slots.withColumn("spell", F.sum("pause").over(Window.partitionBy("k").orderBy("slot"))).select(F.col("k").alias("sk"), F.col("slot").alias("ss"), "spell")
    rows = own.join(slots, F.col("k").eqNullSafe(F.col("sk")) & (F.col("slot") == F.col("ss"))).select("k", "spell", "at", "tie")
    rows = rows.repartition("k", "spell").sortWithinPartitions("k", "spell", "at", "tie")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, log = object(), deque()
        for frame in frames:
            waits = []
            for k, spell, at in zip(frame["k"].astype(object).where(frame["k"].notna(), None), frame["spell"], frame["at"], strict=True):
                if (k, spell) != held:
                    held, log = (k, spell), deque()
                waits.append(decide(log, at, limit, window))
            yield pd.DataFrame({"k": frame["k"], "tie": frame["tie"], "allowed": [w is None for w in waits], "wait_us": pd.array(waits, "Int64")})

    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(run, f"k {kinds['k']}, tie {kinds['tie']}, allowed boolean, wait_us long")
    return out.select(F.col("k").alias(key), F.col("tie").alias(tie), "allowed", "wait_us")


class SlidingLog(StatefulProcessor):
    """Decisions of one key's requests (``at`` in microseconds, ``tie``), which come in order from batch to batch."""

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        log = deque(sorted(r[0] for r in self.log.get()))
        waits = [decide(log, int(at), self.limit, self.window) for at in frame["at"]]
        self._keep(log)
        yield pd.DataFrame({"k": [key[0]] * len(waits), "tie": frame["tie"].to_numpy(), "allowed": [w is None for w in waits], "wait_us": pd.array(waits, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(deque(at for at in sorted(r[0] for r in self.log.get()) if at + self.window > now))
        return iter(())

    def _keep(self, log: deque[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if log:
            self.log.put([(at,) for at in log])
            self.handle.registerTimer((log[-1] + self.window) // 1000 + 1)
        else:
            self.log.clear()

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """``limit_decisions`` of a stream: events may be late within a batch, not behind the one before; needs the RocksDB state store."""
    window = seconds * 1_000_000
    own = events.withWatermark(ts, late).select(F.col(key).alias("k"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).alias("tie")).where("at is not null")
    kinds = dict(own.dtypes)
    schema = f"k {kinds['k']}, tie {kinds['tie']}, allowed boolean, wait_us long"
    out = own.groupBy("k").transformWithStateInPandas(SlidingLog(limit, window), schema, "append", "EventTime")
    return out.select(F.col("k").alias(key), F.col("tie").alias(tie), "allowed", "wait_us")
