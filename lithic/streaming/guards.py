"""Rate limiter and circuit breaker as Structured Streaming, with state per key that outlives restarts, and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lithic.streaming.progress import BURST, OPEN_SECONDS, take, trip

_OUT = "key_text string, id long, at double, granted boolean, state string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keep state in RocksDB, which value state and timers need."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, float, bool]]:
    """(id, at, failed) of a key's rows in one micro-batch by time, then id."""
    parts = [p for p in rows if len(p)]
    if parts:
        whole = pd.concat(parts).sort_values(["at", "id"], kind="stable")
        yield from zip(whole["id"].tolist(), whole["at"].tolist(), whole["failed"].tolist())


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "at", "granted", "state"]).astype({"id": "Int64", "granted": "boolean"})
    out.insert(0, "key_text", [key[0]] * len(rows))
    return out


class TokenBucket(StatefulProcessor):
    """State: tokens left and the time they were counted at."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getValueState("tokens", "tokens double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.tokens.get() if self.tokens.exists() else (BURST, None)
        out = []
        for ident, at, _ in _in_order(rows):
            granted, tokens, last = take(tokens, last, at)
            out.append((ident, at, granted, f"{tokens:.3f}"))
        if out:
            self.tokens.update((tokens, last))
        yield _frame(key, out)

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """State: name, failures in a row, time of opening. A timer set at opening half-opens the breaker when that time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "name string, failures int, opened double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = state = tuple(self.breaker.get()) if self.breaker.exists() else ("closed", 0, 0.0)
        out = []
        for ident, at, failed in _in_order(rows):
            granted, state = trip(state, at, bool(failed))
            out.append((ident, at, granted, state[0]))
        if state != before:
            self.breaker.update(state)
            for set_before in self.handle.listTimers():
                self.handle.deleteTimer(set_before)
            if state[0] == "open":
                self.handle.registerTimer(int((state[2] + OPEN_SECONDS) * 1000))
        yield _frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, failures, opened = self.breaker.get()
        out = []
        if name == "open":
            self.breaker.update(("half-open", failures, opened))
            out.append((None, opened + OPEN_SECONDS, None, "half-open"))
        yield _frame(key, out)

    def close(self) -> None:
        pass


def _guarded(events: DataFrame, processor: StatefulProcessor, late: str) -> DataFrame:
    # by text, since rows of a null key would each be a group of their own
    text = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    timed = events.select("id", "at", "failed", text.alias("key_text"), F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    made = timed.groupBy("key_text").transformWithStateInPandas(processor, _OUT, "Append", "EventTime")
    return made.select(F.col("key_text").try_cast("long").alias("key"), "id", "at", "granted", "state")


def limited_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streaming token bucket over events (key long, null being one like others, id long, at seconds, failed): every event with its grant and the tokens left.

    A micro-batch's events of a key are taken by time, then id, whatever order they arrive in; an event older than one of
    an earlier micro-batch gains no tokens. Events older than the watermark are dropped. State is bounded by the keys.
    """
    return _guarded(events, TokenBucket(), late)


def broken_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streaming circuit breaker over the same events; beside a row per event one with a null id when the timer half-opens a breaker.

    The timer fires when the watermark has passed, so no event before that time is still to come.
    """
    return _guarded(events, Breaker(), late)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, appending to Parquet in `path`, and read all that this stream ever wrote there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
