import duckdb

from lithic.plans import queries
from lithic.plans import structure  # noqa: F401  registers its queries


def test_greedy_confusion_reads_every_event(spark, sf):
    groups = {}
    for c, k, expected in duckdb.sql(f"SELECT user_id % 7, event_type, event_id % 3 = 0 FROM '{sf}/events.parquet'").fetchall():
        groups.setdefault((c, k), [0, 0])[expected] += 1
    want = sorted((*g, min(e, f), f - min(e, f), e - min(e, f)) for g, (f, e) in groups.items())
    assert sum(e + f for f, e in groups.values()) > 300
    got = queries.QUERIES["greedy_confusion"](spark, sf).select("c", "k", "tp", "fp", "fn")
    assert sorted(map(tuple, got.collect())) == want
