"""Walks are counted in cells: no exchange grows with them, and any cut of cells, blocks and chunks gives the same counts."""

import random

import duckdb
import pyarrow as pa
import pytest

from lithic.operators import graphs
from lithic.plans import queries


def written(node):
    """Most bytes that one exchange of an executed plan has written."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return written(node.executedPlan())
    if "QueryStageExec" in kind:
        return written(node.plan())
    below = node.children()
    own = node.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
    return max([own, *(written(below.apply(i)) for i in range(below.size()))])


def counts(edges, starts, depth):
    to, n = {}, {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def walk(path):
        for b in to.get(path[-1], ()) if len(path) <= depth else ():
            if b not in path:
                n[path[0], b, len(path)] = n.get((path[0], b, len(path)), 0) + 1
                walk([*path, b])

    for a in set(starts):
        walk([a])
    return sorted((*k, v) for k, v in n.items())


def test_exchanges_do_not_grow_with_walks(spark):
    """100 starts reach 200 nodes over 50: a million walks of two, 8 MB as long numbers, over 15,000 edges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = [(1000 + s, m) for s in range(100) for m in range(50)] + [(m, 2000 + k) for m in range(50) for k in range(200)]
        frame = spark.createDataFrame(edges, "a long, b long")
        df = graphs.path_counts(frame, frame.selectExpr("a AS node"), 2)
        got = df.collect()
        assert sorted((r.start, r.node, r.n) for r in got if r.depth == 2) == [(1000 + s, 2000 + k, 50) for s in range(100) for k in range(200)]
        assert 0 < written(df._jdf.queryExecution().executedPlan()) < 1_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("most", "walks", "listed"), [(10, 3, 2), (40, 50, 1)])
def test_parts_and_blocks(spark, monkeypatch, most, walks, listed):
    rng = random.Random(5)
    edges = [(a, b) for a in range(-3, 15) for b in range(-3, 18) if rng.random() < 0.35]
    for name, value in {"EDGES": most, "WALKS": walks, "MOST_WALKS": 8 * walks, "LISTED": listed}.items():
        monkeypatch.setattr(graphs, name, value, raising=False)
    frame = spark.createDataFrame([*edges, (2, None), (None, 2)], "a int, b int")
    starts = [-3, 0, 4, 17, 99, 4]
    got = graphs.path_counts(frame, spark.createDataFrame([(x,) for x in starts], "node int"), 3)
    assert got.dtypes == [("start", "int"), ("node", "int"), ("depth", "int"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect())) == counts(edges, starts, 3)


@pytest.mark.parametrize("chunk", [1, 9, 60, 10_000])
@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_chunks_and_batches(monkeypatch, chunk, rows):
    """Two cells with the same edges: each gives the walks of its starts, flat or listed."""
    monkeypatch.setattr(graphs, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(graphs, "LISTED", 3, raising=False)
    rng = random.Random(chunk)
    edges = sorted({(rng.randrange(25), rng.choice((rng.randrange(25), 1000 + rng.randrange(400)))) for _ in range(500)})
    edges = [(a, b) for a, b in edges if a != b]
    first = {s: sorted(b for a, b in edges if a == s) for s in range(25)}
    made = []
    for cell in (0, 1):
        made += [(cell, 0, a, first[a][x : x + 5], []) for a in range(25) for x in range(0, len(first[a]), 5)]
        made += [(cell, 2, s, [b], [1]) for s in range(25) if s % 2 == cell for b in first[s]]
    names = ("cell", "depth", "start", "nodes", "ns")
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made[i : i + rows]), kinds)], names) for i in range(0, len(made), rows)]
    want = [x for x in counts(edges, range(25), 2) if x[2] == 2]
    flat = [tuple(r.values()) for b in graphs._count_walks(False, iter(batches)) for r in b.to_pylist()]
    assert sorted(flat) == want
    lists = [r for b in graphs._count_walks(True, iter(batches)) for r in b.to_pylist()]
    assert sorted((r["start"], node, r["depth"], n) for r in lists for node, n in zip(r["nodes"], r["ns"])) == want
    assert max(len(r["nodes"]) for r in lists) <= 3


def test_call_chain_goes_three_deep_from_every_node(spark, sf):
    edges = duckdb.sql(f"SELECT DISTINCT l_suppkey, l_partkey FROM '{sf}/lineitem.parquet'").fetchall()
    want = counts([e for e in edges if e[0] != e[1]], [a for a, _ in edges], 3)
    got = queries.QUERIES["call_chain"](spark, sf).select("start", "node", "depth", "n").collect()
    assert sorted(map(tuple, got)) == want and {x[2] for x in want} == {1, 2, 3}
    lineitem = duckdb.read_parquet(f"{sf}/lineitem.parquet")  # noqa: F841  read by the SQL
    assert sorted(duckdb.sql(queries.ORACLES["call_chain"]).fetchall()) == want
