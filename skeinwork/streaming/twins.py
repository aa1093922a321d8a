"""Structured Streaming forms of the event operators. Each gives what its batch twin gives once all input is read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream with ts as a timestamp; a watermark needs one with a zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap of `minutes`."""
    w = F.session_window("ts", f"{minutes} minutes")
    return stream.withWatermark("ts", late).groupBy("user_id", w).agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("n")).drop("session_window")


def progress(stream: DataFrame) -> DataFrame:
    """Events handled so far for each user; for the update mode."""
    return stream.groupBy("user_id").agg(F.count("*").alias("processed"), F.max("ts").alias("last"))


BREAKER = "service string, ts timestamp, state string"


def breaker(stream: DataFrame, threshold: int = 3, seconds: float = 30.0) -> DataFrame:
    """Changes of a circuit breaker's state for each service. stream: service, ts, ok.

    `threshold` failures in a row open it; after `seconds` the next event is a single probe, which closes or opens it again.
    """

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, failures, opened = state.get if state.exists else ("closed", 0, 0.0)
        out = []
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ts, ok in zip(rows["ts"], rows["ok"]):
            before, at = now, ts.timestamp()
            if now == "open" and at - opened < seconds:
                continue  # refused
            if ok:
                now, failures = "closed", 0
            else:
                failures += 1
                if now == "open" or failures >= threshold:
                    now, opened = "open", at
            if now != before or (before == "open" and not ok):
                out.append((key[0], ts, now))
        state.update((now, failures, opened))
        yield pd.DataFrame(out, columns=["service", "ts", "state"])

    return stream.groupBy("service").applyInPandasWithState(run, BREAKER, "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value differs from the key's last one. Of a key's rows the order column says which comes first (equal ones by value); the last value is all the state there is."""

    def run(_: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values([order, value], kind="stable")
        keep = []
        for v in rows[value]:
            keep.append(v != last)
            last = v
        state.update((last,))
        yield rows[keep]

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def incremental(stream: DataFrame, store: str, checkpoint: str, key: str, value: str, order: str | None = None) -> StreamingQuery:
    """Append rows whose value is new for their key to a store, with the batch's number; a batch that is run again replaces what it wrote. What is known
    is the stream's state, the store isn't read. Without an order rows of a batch go by value."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("part", F.lit(number)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store)

    return changes(stream, key, value, order or value).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def journal(stream: DataFrame, flush: int = 5, compact: int = 20) -> DataFrame:
    """Journal entries of a stream of turns (session_id, ts, role, content), each with its number in the session and whether the journal is flushed or looked at for compaction after it."""
    from skeinwork.operators.journal import turn_entry

    entry = turn_entry(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("role"), F.col("content"))

    def run(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["ts", "entry"], kind="stable")
        rows["n"] = range(n + 1, n + 1 + len(rows))
        rows["flush"], rows["compact"] = rows["n"] % flush == 0, rows["n"] % compact == 0
        state.update((n + len(rows),))
        yield rows

    made = stream.select("session_id", "ts", entry.alias("entry"))
    return made.groupBy("session_id").applyInPandasWithState(run, "session_id string, ts timestamp, entry string, n long, flush boolean, compact boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def appended(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append journal entries (session_id, ts, entry) to daily logs."""
    return entries.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).writeStream.outputMode("append").option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).format("parquet").start(path)


def hook_entries(stream: DataFrame) -> DataFrame:
    """Hook events as journal entries; see operators.journal.entries_of."""
    from skeinwork.operators.journal import entries_of

    return entries_of(stream)


def progress_states(stream: DataFrame) -> DataFrame:
    """The last known state of each indexing run (repo_id, ts, processed, total, status) with percent and the seconds left at the pace so far; for the update mode."""
    g = stream.groupBy("repo_id").agg(F.max_by(F.struct("processed", "total", "status"), "ts").alias("x"), F.min("ts").alias("begin"), F.max("ts").alias("last"))
    spent = F.col("last").cast("double") - F.col("begin").cast("double")
    left = F.when((F.col("x.processed") > 0) & ~F.col("x.status").isin("complete", "cancelled"), (F.col("x.total") - F.col("x.processed")) * spent / F.col("x.processed")).otherwise(0.0)
    return g.select("repo_id", "x.processed", "x.total", "x.status", F.when(F.col("x.total") > 0, F.round(100.0 * F.col("x.processed") / F.col("x.total"), 2)).otherwise(0.0).alias("percent"), F.round(left, 2).alias("eta"))


CACHE = "cache string, ts timestamp, op string, key string, hit boolean, hits long, misses long, evictions long"


def cached(stream: DataFrame, capacity: int = 256, seconds: float = 3600.0) -> DataFrame:
    """What a cache answers to operations (cache, ts, op, key): get is a hit if the key was set less than `seconds` ago and isn't evicted since; set evicts the least recently
    used of more than `capacity` keys; invalidate drops keys that begin so. The state is the keys held and three counters."""

    def run(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, hits, misses, evictions = state.get if state.exists else ("{}", 0, 0, 0)
        entries, out = json.loads(held), []  # least recently used first
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ts, op, key in zip(rows["ts"], rows["op"], rows["key"]):
            now, hit = ts.timestamp(), None
            if op == "get":
                at = entries.pop(key, None)
                hit = at is not None and now - at < seconds
                if hit:
                    entries[key] = at
                hits, misses = hits + hit, misses + (not hit)
            elif op == "set":
                entries.pop(key, None)
                entries[key] = now
                if len(entries) > capacity:
                    del entries[next(iter(entries))]
                    evictions += 1
            else:
                entries = {k: v for k, v in entries.items() if not k.startswith(key)}
            out.append((group[0], ts, op, key, hit, hits, misses, evictions))
        state.update((json.dumps(entries), hits, misses, evictions))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CACHE.split(", ")])

    return stream.groupBy("cache").applyInPandasWithState(run, CACHE, "held string, hits long, misses long, evictions long", "append", GroupStateTimeout.NoTimeout)


def fanned_out(stream: DataFrame, subscribers: list[Callable[[list[str]], None]], checkpoint: str) -> StreamingQuery:
    """Send each batch's rows as JSON events to all subscribers; one that fails is dropped. For progress events, of which a batch has few."""

    def put(batch: DataFrame, _: int) -> None:
        events = [as_event(r.asDict()) for r in batch.toLocalIterator()]
        for s in list(subscribers):
            try:
                s(events)
            except Exception:  # noqa: BLE001
                subscribers.remove(s)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream gives for the input there is, as a table in memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def as_event(row: dict) -> str:
    """A progress event as JSON."""
    return json.dumps(row, sort_keys=True, default=str)
