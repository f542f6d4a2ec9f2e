"""Structured Streaming with keyed state that ends: attempts of jobs under a time limit, entries that are retained for a while, and spans of two streams.

State is kept for a key from its first row until a timer of event time ends it, so it is bounded by the keys of the
last limit or retention, not by the stream. Timers fire once the watermark has passed them. Rows of one batch are
taken in the order of their times; rows behind the watermark are dropped before they reach the state, as in any such
stream. A restart goes on from the checkpoint with state, timers and watermark as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fields(**kinds: type) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


# times are microseconds since 1970 wherever Python sees them
_JOB = _fields(generation=LongType, attempts=IntegerType, fails=IntegerType, began=LongType, last=LongType, over=BooleanType)
_ATTEMPT = _fields(job=StringType, attempt=IntegerType, started=LongType, ended=LongType, outcome=StringType)
_ENTRY = _fields(began=LongType, ended=LongType, n=LongType, status=StringType)
_ENDED = StructType([StructField("id", StringType()), *_ENTRY.fields])


class _Keyed(StatefulProcessor):
    """One value a key, and one timer."""

    kind: StructType
    result: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.kind)

    def held(self) -> dict | None:
        return dict(zip(self.kind.names, self.value.get(), strict=True)) if self.value.exists() else None

    def keep(self, state: dict, until: int) -> None:
        """Keep a state until a time (microseconds), when the timer fires."""
        self.value.update(tuple(state[n] for n in self.kind.names))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until // 1000 + 1)

    def rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.result.names)

    def close(self) -> None:
        pass


class _Jobs(_Keyed):
    """A job's generation, attempts so far, failures, when the running attempt began (None: none runs), its last step, whether it is over."""

    kind, result = _JOB, _ATTEMPT

    def __init__(self, limit: int, retries: int, retain: int):
        self.limit, self.retries, self.retain = limit, retries, retain

    def _end(self, job: str, s: dict, at: int, outcome: str) -> tuple:
        row = (job, s["attempts"], s["began"], at, outcome)
        s["fails"] += outcome != "completed"
        s["began"], s["over"] = None, outcome == "completed" or s["fails"] > self.retries
        return row

    def _keep(self, s: dict) -> None:
        self.keep(s, s["last"] + self.retain if s["began"] is None else s["began"] + self.limit)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.held(), []
        for r in pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable").itertuples(index=False):
            if s is not None and s["began"] is not None and r.us > s["began"] + self.limit:
                out.append(self._end(key[0], s, s["began"] + self.limit, "timeout"))
                s["last"] = max(s["last"], out[-1][3])
            if s is not None and s["began"] is None and r.us > s["last"] + self.retain:
                s = None  # its timer was due before this step
            if s is not None and r.generation < s["generation"]:
                continue  # of a generation that has been replaced
            if s is None or r.generation > s["generation"]:
                s = {"generation": int(r.generation), "attempts": 0, "fails": 0, "began": None, "last": int(r.us), "over": False}
            s["last"] = max(s["last"], int(r.us))
            if s["over"]:
                continue
            if r.step == "started" and s["began"] is None:
                s["attempts"], s["began"] = s["attempts"] + 1, int(r.us)
            elif r.step in ("completed", "failed") and s["began"] is not None:
                out.append(self._end(key[0], s, int(r.us), r.step))
        self._keep(s)
        yield from self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self.held(), []
        if s is not None and s["began"] is not None:
            out.append(self._end(key[0], s, s["began"] + self.limit, "timeout"))
            s["last"] = max(s["last"], out[0][3])
            self._keep(s)
        else:
            self.value.clear()
        yield from self.rows(out)


def job_attempts(steps: DataFrame, late: str = "1 minute", limit_s: int = 45, retries: int = 2, retain_s: int = 3600) -> DataFrame:
    """Streaming: (job, attempt, started, ended, outcome) of steps (job string, generation long, at timestamp, seq long, step string).

    An attempt runs from `started` to the next `completed` or `failed`, or ends as `timeout` limit_s seconds after it; a
    start while one runs changes nothing. A job is over once it has completed, or failed or timed out more than `retries`
    times. A new generation begins the job anew, steps of an older one are dropped. What is known of a job goes
    retain_s after its last step. Needs the RocksDB state store (PROVIDER).
    """
    rows = steps.withWatermark("at", late).select("job", "generation", "at", F.unix_micros("at").alias("us"), "seq", "step")
    got = rows.groupBy("job").transformWithStateInPandas(_Jobs(limit_s * 1_000_000, retries, retain_s * 1_000_000), _ATTEMPT, "append", "EventTime")
    return got.select("job", "attempt", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "outcome")


class _Retained(_Keyed):
    """When an entry began, its last report, how many it had, its status."""

    kind, result = _ENTRY, _ENDED

    def __init__(self, retain: int):
        self.retain = retain

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.held(), []
        for r in pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable").itertuples(index=False):
            if s is not None and r.us > s["ended"] + self.retain:
                out.append((key[0], *s.values()))
                s = None
            s = {"began": int(r.us) if s is None else s["began"], "ended": int(r.us), "n": 1 if s is None else s["n"] + 1, "status": r.status}
        self.keep(s, s["ended"] + self.retain)
        yield from self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.held()
        self.value.clear()
        yield from self.rows([(key[0], *s.values())] if s else [])


def retained_entries(reports: DataFrame, late: str = "1 minute", retain_s: int = 3600) -> DataFrame:
    """Streaming: (id, began, ended, n, status) of each entry once nothing has been reported of it for retain_s seconds.

    reports (id string, at timestamp, seq long, status string): an entry lasts as long as no two of its reports are
    more than retain_s apart; its status is the last one. What comes later begins a new entry of the same id.
    """
    rows = reports.withWatermark("at", late).select("id", "at", F.unix_micros("at").alias("us"), "seq", "status")
    got = rows.groupBy("id").transformWithStateInPandas(_Retained(retain_s * 1_000_000), _ENDED, "append", "EventTime")
    return got.select("id", F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n", "status")


def joined_spans(started: DataFrame, ended: DataFrame, late: str = "10 minutes", limit: str = "1 day") -> DataFrame:
    """Streaming: (id, start_seq, started, ended, status) of started (id, seq, at) and ended (id, seq, at, status): a row for each end within `limit` of a start.

    A start without one comes out with nulls once both streams' watermark shows that none can come any more; ends
    without a start come to nothing. Both sides' rows are dropped from the state by then.
    """
    s = started.select("id", F.col("seq").alias("start_seq"), F.col("at").alias("started")).withWatermark("started", late)
    e = ended.select(F.col("id").alias("e_id"), F.col("at").alias("ended"), "status").withWatermark("ended", late)
    within = (F.col("id") == F.col("e_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {limit}"))
    return s.join(e, within, "left_outer").select("id", "start_seq", "started", "ended", "status")


def first_ends(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of each span the first of its ends; null if it has none."""
    end = F.struct("ended", "status")
    return spans.groupBy(*keys).agg(F.min(F.when(F.col("ended").isNotNull(), end)).alias("e")).select(*keys, "e.ended", "e.status")
