"""The graph queries see every edge of their table."""

import duckdb
import pytest

from lithic.operators import graphs
from lithic.plans import queries


@pytest.fixture(scope="module")
def edges(sf):
    return set(duckdb.sql(f"SELECT DISTINCT l_suppkey, l_partkey FROM '{sf}/lineitem.parquet'").fetchall())


def rows(spark, sf, name, *columns):
    return sorted(map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect()))


def test_edges_at_given_nodes(spark, sf, edges):
    parts = {p for (p,) in duckdb.sql(f"SELECT p_partkey FROM '{sf}/part.parquet' WHERE p_size = 7").fetchall()}
    assert parts
    touched = {e for e in edges if parts & set(e)}
    assert rows(spark, sf, "touching_edges", "a", "b") == sorted(touched)
    assert rows(spark, sf, "or_endpoint_delete", "a", "b") == sorted(edges - touched)
    out, into = [(a, b, "out") for a, b in edges if 1 <= a <= 3], [(a, b, "in") for a, b in edges if 1 <= b <= 3]
    assert rows(spark, sf, "ego_network", "a", "b", "direction") == sorted(out + into)


def test_impact(spark, sf, edges):
    depth = {1: 0}
    for step in (1, 2, 3):
        known = set(depth)
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x in known:
                    depth.setdefault(y, step)
    assert rows(spark, sf, "impact_bfs", "node", "depth") == sorted(depth.items())


@pytest.mark.parametrize("depth", [2, 3])
def test_call_chain_from_every_node(spark, sf, edges, depth):
    to, n = {}, {}
    for a, b in edges:
        to.setdefault(a, []).append(b)

    def walk(path):
        for b in to.get(path[-1], ()) if len(path) <= depth else ():
            if b not in path:
                n[path[0], b, len(path)] = n.get((path[0], b, len(path)), 0) + 1
                walk([*path, b])

    for a in to:
        walk([a])
    if depth == 2:
        assert rows(spark, sf, "call_chain", "start", "node", "depth", "n") == sorted((*k, v) for k, v in n.items())
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    found = graphs.paths_from(frame, frame.selectExpr("a AS node").distinct(), depth).groupBy("start", "node", "depth").count()
    assert sorted(map(tuple, found.collect())) == sorted((*k, v) for k, v in n.items())
    counted = graphs.path_counts(frame, frame.selectExpr("a AS node"), depth)
    assert sorted(map(tuple, counted.collect())) == sorted((*k, v) for k, v in n.items())


def test_counts_of_paths_in_a_small_dense_graph(spark):
    edges = {(a, b) for a in range(7) for b in range(7) if (a * 5 + b * 3) % 4} | {(9, 0)}
    n = {}

    def walk(path):
        for a, b in edges:
            if a == path[-1] and b not in path and len(path) <= 3:
                n[path[0], b, len(path)] = n.get((path[0], b, len(path)), 0) + 1
                walk([*path, b])

    for a in (0, 3, 9):
        walk([a])
    frame = spark.createDataFrame(sorted(edges) * 2, "a long, b long")
    starts = spark.createDataFrame([(0,), (3,), (9,), (3,), (50,)], "node long")
    assert sorted(map(tuple, graphs.path_counts(frame, starts, 3).collect())) == sorted((*k, v) for k, v in n.items())
