"""Progress, cost and rate control: as windows over tables, and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QPS, BURST = 3.0, 5.0
FAILURES, OPEN_SECONDS = 5, 30.0


def changed(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Events at which any value differs from the key's event before; the first counts as changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = events.withColumn("__new", F.row_number().over(w) == 1)
    for v in values:
        marked = marked.withColumn("__new", F.col("__new") | ~F.col(v).eqNullSafe(F.lag(v).over(w)))
    return marked.where("__new").drop("__new")


def running_max(events: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(out, F.max(value).over(w))


def recent(events: DataFrame, at: str, interval: str) -> DataFrame:
    """Events less than `interval` before the last one."""
    last = events.agg(F.max(at).alias("__last"))
    return events.crossJoin(last).where(F.col(at) > F.col("__last") - F.expr(f"INTERVAL {interval}")).drop("__last")


def costs(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def newest(events: DataFrame, order: list[str], most: int) -> DataFrame:
    return events.orderBy(*(F.desc(c) for c in order)).limit(most)


def over_budget(events: DataFrame, keys: list[str], order: list[str], value: str, budget: float) -> DataFrame:
    """Events with what was spent before them and whether they would pass the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(value).over(w), F.lit(0.0))
    return events.withColumn("spent", spent).withColumn("denied", F.col("spent") + F.col(value) > budget)


def deduplicated(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return messages.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def retry_decision(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """(key, tries, last_status) with a decision: limit first, then no history, then success, else accept."""
    d = F.when(F.col("tries") >= limit, "limit reached").when(F.col("last_status").isNull(), "no history").when(F.col("last_status") == "success", "already done").otherwise("accept")
    return attempts.withColumn("decision", d)


def reduced(updates: DataFrame, key: str, order: str) -> DataFrame:
    """Parallel branches' updates (value, progress, title, status) as one state per key: first, last and greatest value, titles once, failed if any is."""
    return updates.groupBy(key).agg(
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.max("progress").alias("progress"),
        F.array_sort(F.collect_set("title")).alias("titles"), F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.max_by("status", order)).alias("status"),
    )


def take(tokens: float, last: float | None, at: float, asked: float = 1.0) -> tuple[bool, float, float]:
    """(granted, tokens left, time): a bucket that gains QPS tokens a second up to BURST."""
    tokens = BURST if last is None else min(BURST, tokens + max(0.0, at - last) * QPS)
    return (True, tokens - asked, at) if tokens >= asked else (False, tokens, at)


def trip(state: tuple[str, int, float], at: float, failed: bool) -> tuple[bool, tuple[str, int, float]]:
    """(let through, state) of a breaker (closed, open or half-open; failures; opened at)."""
    name, failures, opened = state
    if name == "open":
        if at - opened < OPEN_SECONDS:
            return False, state
        name = "half-open"
    if not failed:
        return True, ("closed", 0, 0.0)
    failures += 1
    return True, ("open", failures, at) if name == "half-open" or failures >= FAILURES else ("closed", failures, 0.0)


_FOLDED = "key long, id long, at double, granted boolean, state string"


def _folded(events: DataFrame, fold, start) -> DataFrame:
    """Each event after `fold`: (state, at, failed) -> (state, (granted, text)), per key in order of time, then id.

    A key's events come sorted through one task in batches and only the state is kept between them, so a key may have
    any number of events; null is a key like others, and repeated events each count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, first = None, start, True
        for batch in batches:
            out = []
            for key, at, failed in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "failed"))):
                if first or key != of:
                    of, state, first = key, start, False
                state, row = fold(state, at, failed)
                out.append(row)
            granted, text = pa.array([r[0] for r in out], pa.bool_()), pa.array([r[1] for r in out], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "at")), granted, text], names=["key", "id", "at", "granted", "state"])

    dealt = events.select("key", "id", "at", "failed").repartition("key").sortWithinPartitions("key", "at", "id")
    return dealt.mapInArrow(run, _FOLDED)


def limited(events: DataFrame) -> DataFrame:
    """Token bucket per key over events (key, id, at seconds, failed), in order of time; state holds the tokens left."""

    def fold(state, at, _):
        granted, tokens, last = take(state[0], state[1], at)
        return (tokens, last), (granted, f"{tokens:.3f}")

    return _folded(events, fold, (BURST, None))


def broken(events: DataFrame) -> DataFrame:
    """Circuit breaker per key over the same events; state is the breaker's name after the event."""

    def fold(state, at, failed):
        granted, state = trip(state, at, bool(failed))
        return state, (granted, state[0])

    return _folded(events, fold, ("closed", 0, 0.0))


def reported(events: DataFrame, keys: list[str], order: list[str], step: str, percent: str, total: str) -> DataFrame:
    """What a watcher of a task hears, in order: `event` is progress, complete or error.

    Progress is told when step or percent differ from the event before, beginning with the first such change whose
    `total` is above 0. The first COMPLETED or FAILED step is told a second time, as complete or error, told before or
    not; nothing follows it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col(step).isin("COMPLETED", "FAILED")
    differs = (F.row_number().over(w) == 1) | ~F.col(step).eqNullSafe(F.lag(step).over(w)) | ~F.col(percent).eqNullSafe(F.lag(percent).over(w))
    marked = events.withColumns({"__ended": F.coalesce(F.bool_or(ends).over(before), F.lit(False)), "__changed": differs}).where("not __ended")
    known = F.coalesce(F.bool_or(F.col("__changed") & (F.col(total) > 0)).over(so_far), F.lit(False))
    last = F.when(F.col(step) == "COMPLETED", "complete").when(F.col(step) == "FAILED", "error")
    told = marked.withColumn("event", F.array_compact(F.array(F.when(F.col("__changed") & known, "progress"), last)))
    return told.drop("__ended", "__changed").withColumn("event", F.explode("event"))


def changes_of_stream(events: DataFrame) -> DataFrame:
    """Streaming (key, percent, step) of events (key, percent, step, at): a row when a key's percent or step changes; the state is the last pair.

    A micro-batch's events of a key are taken in order of `at`, whatever order they arrive in; of those at one time by
    percent, then step.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get if state.exists else (None, None)), []
        own = pd.concat(list(parts)).sort_values(["at", "percent", "step"], kind="stable")
        for percent, name in zip(own["percent"], own["step"]):
            if (percent, name) != tuple(last):
                last = (float(percent), name)
                out.append((key[0], *last))
        state.update(tuple(last))
        yield pd.DataFrame(out, columns=["key", "percent", "step"])

    return events.groupBy("key").applyInPandasWithState(step, "key long, percent double, step string", "percent double, step string", "append", GroupStateTimeout.NoTimeout)


def windowed_costs(events: DataFrame, at: str, key: str, value: str, length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sums per sliding window and key, of a stream (with a watermark) or a table."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, length, slide), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def first_seen(stream: DataFrame, keys: list[str], at: str, ttl: str = "24 hours") -> DataFrame:
    """Streaming cache by key: a key's row passes unless one passed within `ttl`."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)
