"""Stateful operators with timers: what is due happens without a next event of its key.

They run in Spark's transformWithState, whose state is in RocksDB: `with_timers` sets that. Timers are of event time (they go off when the watermark has passed them,
whosever events moved it) or of processing time (no event is needed at all).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _at(ms: float) -> pd.Timestamp:
    return pd.Timestamp(int(ms), unit="ms")


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


BREAKER = T.StructType([T.StructField("service", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("state", T.StringType())])


class _Breaker(StatefulProcessor):
    def __init__(self, threshold: int, seconds: float):
        self.threshold, self.wait = threshold, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "state string, failures int, opened long")

    def _rows(self, key: tuple, rows: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"service": [key[0]] * len(rows), "ts": [_at(ms) for ms, _ in rows], "state": [s for _, s in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, failures, opened = self.state.get() if self.state.exists() else ("closed", 0, 0)
        out: list[tuple[int, str]] = []
        events = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for at, ok in zip(map(_ms, events["ts"]), events["ok"]):
            if now == "open":
                if at < opened + self.wait:
                    continue  # refused
                out.append((opened + self.wait, "half_open"))  # the timer's turn would have come later
                self.handle.deleteTimer(opened + self.wait)
                now = "half_open"
            if ok:
                if now != "closed":
                    out.append((at, "closed"))
                now, failures = "closed", 0
            else:
                failures += 1
                if now == "half_open" or failures >= self.threshold:
                    now, opened = "open", at
                    out.append((at, "open"))
                    self.handle.registerTimer(opened + self.wait)
        self.state.update((now, failures, opened))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, failures, opened = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if now == "open" and opened + self.wait == due:
            self.state.update(("half_open", failures, opened))
            yield from self._rows(key, [(due, "half_open")])

    def close(self) -> None:
        pass


def breaker(stream: DataFrame, threshold: int = 3, seconds: float = 30.0, late: str = "10 seconds", clock: str = "EventTime") -> DataFrame:
    """Changes of each service's circuit breaker: service, ts, state. stream: service, ts (timestamp), ok.

    `threshold` failures in a row open it; `seconds` later it is half open, whether an event comes or not; the next event closes it or opens it again, those before are refused. An event
    that comes later than the watermark is dropped.
    """
    timed = stream.withWatermark("ts", late) if clock == "EventTime" else stream
    return timed.groupBy("service").transformWithStateInPandas(_Breaker(threshold, seconds), BREAKER, "Append", clock)


class _Sessions(StatefulProcessor):
    def __init__(self, minutes: float):
        self.gap = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = [tuple(s) for s in self.open.get()] + [(ms, ms, 1) for part in rows for ms in map(_ms, part["ts"])]
        found.sort()
        merged: list[tuple[int, int, int]] = []
        for first, last, n in found:
            if merged and first < merged[-1][1] + self.gap:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, last), m + n)
            else:
                merged.append((first, last, n))
        self.open.put(merged)
        for _, last, _ in merged:
            self.handle.registerTimer(last + self.gap)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        found = [tuple(s) for s in self.open.get()]
        over = [s for s in found if s[1] + self.gap <= due]
        if not over:
            return  # it went on after this timer was set
        left = [s for s in found if s[1] + self.gap > due]
        self.open.put(left) if left else self.open.clear()
        yield pd.DataFrame({"user_id": [key[0]] * len(over), "session_start": [_at(a) for a, _, _ in over], "session_end": [_at(b) for _, b, _ in over], "n": [n for _, _, n in over]})

    def close(self) -> None:
        pass


SESSIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("session_start", T.TimestampType()), T.StructField("session_end", T.TimestampType()), T.StructField("n", T.LongType())])


def sessions(stream: DataFrame, minutes: float = 30, late: str = "1 hour") -> DataFrame:
    """Sessions (user_id, session_start, session_end, n) of a stream (user_id, ts), each once it is over: `minutes` after its last event by the watermark. A user's open sessions are all the state."""
    return stream.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(_Sessions(minutes), SESSIONS, "Append", "EventTime")
