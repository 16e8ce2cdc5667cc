from pyspark.sql import functions as F

from lithic.streaming import progress


def drain(frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def test_stream_of_changes_equals_the_table_form(spark, tmp_path):
    rows = [(1, 0.0, "a", 1), (1, 0.0, "a", 2), (1, 5.0, "a", 3), (2, 1.0, "x", 4), (1, 5.0, "b", 5)]
    events = spark.createDataFrame(rows, "key long, percent double, step string, at int")
    for k, r in enumerate(rows):
        spark.createDataFrame([r], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(progress.changes_of_stream(stream), "changes")
    batch = progress.changed(events, ["key"], ["at"], ["percent", "step"])
    assert sorted((r.key, r.percent, r.step) for r in got.collect()) == sorted((r.key, r.percent, r.step) for r in batch.collect())


def test_changes_go_by_time_within_a_micro_batch(spark, tmp_path):
    rows = [(1, 5.0, "b", 4), (1, 0.0, "a", 1), (2, 1.0, "x", 9), (1, 5.0, "a", 3), (1, 0.0, "a", 2), (2, 1.0, "x", 1)]
    events = spark.createDataFrame(rows, "key long, percent double, step string, at int")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(progress.changes_of_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), "in_time")
    assert [(r.percent, r.step) for r in got.where("key = 1").collect()] == [(0.0, "a"), (5.0, "a"), (5.0, "b")] and got.where("key = 2").count() == 1


def test_windows_with_watermark_and_cache(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "m", 1.0), ("2024-01-01 12:00:00", "m", 2.0), ("2024-01-05 00:00:00", "m", 4.0), ("2024-01-20 00:00:00", "m", 8.0)]
    events = spark.createDataFrame(rows, "ts string, model string, cost double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(progress.windowed_costs(stream, "ts", "model", "cost", "7 days", "7 days"), "costs")
    batch = {(r.window.start, r.total) for r in progress.windowed_costs(events, "ts", "model", "cost", "7 days", "7 days").collect()}
    closed = {(r.window.start, r.total) for r in got.collect()}
    assert closed and closed < batch
    assert drain(progress.first_seen(stream, ["model"], "ts"), "seen").count() == 1


def test_bucket_and_breaker():
    state, granted = (progress.BURST, None), []
    for at in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.4, 10.0):
        ok, tokens, last = progress.take(state[0], state[1], at)
        state = (tokens, last)
        granted.append(ok)
    assert granted == [True] * 5 + [False, True, True]
    breaker, passed = ("closed", 0, 0.0), []
    for at, failed in [(i, True) for i in range(5)] + [(6.0, False), (40.0, True), (41.0, False), (80.0, False)]:
        ok, breaker = progress.trip(breaker, at, failed)
        passed.append((ok, breaker[0]))
    assert passed == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed")]
