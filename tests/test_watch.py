import threading
import time

import pytest
from pyspark.sql import functions as F

from lithic.streaming import watch as w


def test_steps_report_their_progress(spark):
    told = []
    work = w.Work(spark, [("count", lambda s: s.range(10).count()), ("sum", lambda s: s.range(5).agg(F.sum("id")).first()[0])], lambda *x: told.append(x))
    assert work.run() == [10, 10]
    assert told == [(0, 2, "count"), (1, 2, "sum"), (2, 2, "")]
    assert [(r.step, r.percent, r.name, r.status, r.n) for r in work.progress().collect()] == [(0, 0.0, "count", "done", 10), (1, 50.0, "sum", "done", 10), (2, 100.0, "", "completed", None)]


def test_a_step_that_fails(spark):
    work = w.Work(spark, [("a", lambda s: 1), ("b", lambda s: 1 // 0), ("c", lambda s: 2)])
    with pytest.raises(ZeroDivisionError):
        work.run()
    assert [(r[4], r[5]) for r in work.rows] == [("a", "done"), ("b", "running"), ("b", "failed")]


def test_cancelling_stops_the_running_job_and_no_other(spark):
    slow = lambda s: s.range(0, 200, 1, 200).mapInArrow(_sleep, "id long").count()
    work, ran = w.Work(spark, [("slow", slow), ("never", lambda s: ran.append(1))]), []
    ends, other = [], []

    def run():
        try:
            work.run()
        except w.Cancelled as e:
            ends.append(str(e))

    thread, beside = threading.Thread(target=run), threading.Thread(target=lambda: other.append(spark.range(0, 40, 1, 40).mapInArrow(_sleep, "id long").count()))
    began = time.time()
    thread.start()
    time.sleep(2)
    beside.start()
    work.cancel()
    thread.join(30)
    assert ends == [work.task_id] and not ran and time.time() - began < 25 and work.rows[-1][5] == "cancelled"
    beside.join(60)
    assert other == [40]
    early = w.Work(spark, [("x", lambda s: ran.append(1))])
    early.cancel()
    with pytest.raises(w.Cancelled):
        early.run()
    assert not ran


def _sleep(batches):
    import time

    time.sleep(0.3)
    yield from batches


def test_counts_while_writing(spark, tmp_path):
    rows, counts = w.counted(spark.range(100), "ids", {"even": F.col("id") % 2 == 0, "unknown": F.lit(None).cast("boolean")})
    rows.write.parquet(str(tmp_path / "out"))
    assert counts() == {"rows": 100, "even": 50, "unknown": 0}


def test_streams_are_logged(spark, tmp_path):
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []
    log = w.StreamLog(told.append)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count("*").alias("n"))
        query = stream.writeStream.format("memory").queryName("logged").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while time.time() < until and not any(r[2] == "ended" for r in log.rows):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert [r[2] for r in log.rows][0] == "started" and ("logged", 0, "progress", 30) in log.rows and ("logged", 0, "seen.n", 30) in log.rows and told == list(log.rows)
