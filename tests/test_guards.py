import random

import pytest

from lithic.streaming import guards as g
from lithic.streaming import progress as pg

SCHEMA = "key long, id long, at double, failed boolean"


@pytest.fixture
def events():
    rng = random.Random(6)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice((0.01, 0.01, 0.01, 0.05, 0.05, 0.1, 0.3) * 9 + (40.0,))
        rows.append((rng.choice((1, 2, 3, None)), i, round(at, 3), rng.random() < 0.7))
    return rows


def stream_of(spark, folder):
    return g.with_state_store(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("kind", ["limited", "broken"])
def test_three_batches_and_a_restart_equal_the_table_form(spark, tmp_path, events, kind):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    made, folder, out, checkpoint = getattr(g, f"{kind}_stream"), *(str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    cuts = (0, 150, 151, 400)
    for k in (0, 1):
        part = events[cuts[k] : cuts[k + 1]]
        random.Random(k).shuffle(part)
        put(spark, part, folder)
    g.run_to_end(made(stream_of(spark, folder), "60 seconds"), out, checkpoint)
    put(spark, events[cuts[2] :], folder)
    rows = g.run_to_end(made(stream_of(spark, folder), "60 seconds"), out, checkpoint).collect()
    table = getattr(pg, kind)(spark.createDataFrame(events, SCHEMA)).collect()
    order = lambda found: sorted(found, key=lambda r: r[0])
    got = order((r.id, r.key, r.at, r.granted, r.state) for r in rows if r.id is not None)
    assert got == order((r.id, r.key, r.at, r.granted, r.state) for r in table)
    assert {r.granted for r in table} == {True, False}


def test_a_timer_half_opens_without_an_event_of_the_key(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put(spark, [(1, i, i + 1.0, True) for i in range(6)], folder)
    put(spark, [(2, 100, 500.0, False)], folder)
    put(spark, [(2, 101, 500.5, False)], folder)  # the watermark of the batch before fires the timer
    put(spark, [(1, 200, 501.0, True), (1, 201, 502.0, True)], folder)
    rows = g.run_to_end(g.broken_stream(stream_of(spark, folder), "1 second"), out, checkpoint).collect()
    assert [(r.at, r.granted, r.state) for r in rows if r.key == 1 and r.id is None][:1] == [(35.0, None, "half-open")]
    by_id = {r.id: (r.granted, r.state) for r in rows if r.id is not None}
    assert by_id[4] == (True, "open") and by_id[5] == (False, "open")
    assert by_id[200] == (True, "open") and by_id[201] == (False, "open")  # tried once, failed, shut again
