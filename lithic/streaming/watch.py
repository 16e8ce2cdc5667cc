"""Progress and cancellation of work: steps under a job tag, counters that Spark fills while it writes, and what streams report."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: Rows of progress kept at most; older ones go.
KEPT = 1000
ROWS = "task_id string, step long, steps long, percent double, name string, status string, n long"
Callback = Callable[[int, int, str], None]


class Cancelled(Exception):
    """The work was cancelled."""


class Work:
    """A task of named steps, each a function of the session; run one after the other under one job tag.

    callback(done, steps, name) is called before each step and at the end. `cancel`, from any thread, stops the step that runs by its
    tag and the ones after it; other tasks of the session go on. `rows` is what happened, newest last, of bounded length.
    """

    def __init__(self, spark: SparkSession, steps: list[tuple[str, Callable[[SparkSession], object]]], callback: Callback | None = None, task_id: str | None = None):
        self.spark, self.steps, self.callback = spark, steps, callback
        self.task_id = task_id or uuid.uuid4().hex
        self.rows: deque[tuple] = deque(maxlen=KEPT)
        self._stop = threading.Event()

    @property
    def tag(self) -> str:
        return f"task-{self.task_id}"

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _tell(self, step: int, name: str, status: str, n: int | None = None) -> None:
        total = len(self.steps)
        self.rows.append((self.task_id, step, total, 100.0 * step / max(1, total), name, status, n))
        if self.callback:
            self.callback(step, total, name)

    def run(self) -> list:
        """Results of the steps in order; Cancelled if it was, else the error of the step that failed."""
        context, out = self.spark.sparkContext, []
        context.addJobTag(self.tag)
        name = ""
        try:
            for k, (name, step) in enumerate(self.steps):
                if self._stop.is_set():
                    raise Cancelled(self.task_id)
                self._tell(k, name, "running")
                made = step(self.spark)
                out.append(made)
                self.rows[-1] = (*self.rows[-1][:5], "done", made if isinstance(made, int) else None)
            if self._stop.is_set():
                raise Cancelled(self.task_id)
            self._tell(len(self.steps), "", "completed")
        except Exception as error:
            cancelled = self._stop.is_set()
            self._tell(len(out), name, "cancelled" if cancelled else "failed")
            if cancelled and not isinstance(error, Cancelled):
                raise Cancelled(self.task_id) from error
            raise
        finally:
            context.removeJobTag(self.tag)
        return out

    def progress(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows), ROWS)


def counted(rows: DataFrame, name: str, checks: dict[str, Column] | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """(rows, counts): counts() are the rows, and those for which each check holds, once `rows` has been written or read to its end."""
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    held = [F.count_if(F.coalesce(test, F.lit(False))).alias(check) for check, test in (checks or {}).items()]
    return rows.observe(watch, F.count("*").alias("rows"), *held), lambda: watch.get


class StreamLog(StreamingQueryListener):
    """What the streams of a session do: rows (query, batch, event, n) of bounded length, each also given to a callback if there is one.

    Observed metrics of a batch come as their own rows, the event being `observation.metric`.
    """

    def __init__(self, callback: Callable[[tuple], None] | None = None):
        self.rows: deque[tuple] = deque(maxlen=KEPT)
        self.callback = callback

    def _tell(self, row: tuple) -> None:
        self.rows.append(row)
        if self.callback:
            self.callback(row)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._tell((event.name, None, "started", None))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        told = event.progress
        self._tell((told.name, told.batchId, "progress", told.numInputRows))
        for watch, row in told.observedMetrics.items():
            for metric, value in row.asDict().items():
                self._tell((told.name, told.batchId, f"{watch}.{metric}", value))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._tell((None, None, "failed" if event.exception else "ended", None))
