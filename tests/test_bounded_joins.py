"""Joins of tables that grow are shuffled, also where Spark takes them for small ones."""

import re

from lithic.operators import matching as mt
from lithic.plans import kept, queries, structure  # noqa: F401  register their queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_are_not_broadcast(spark, sf):
    assert "Broadcast" not in plan(queries.QUERIES["components_by_descendants"](spark, sf))


def test_module_paths_are_not_broadcast(spark, sf):
    assert "Broadcast" not in plan(queries.QUERIES["module_paths"](spark, sf))


def test_module_paths_prefer_endings_in_order(spark):
    names = ["", "a", "a.py", "a.ts", "a/b", "a/b.c", "a/__init__.py", "a/index.js", "/index.ts", ".py", "a.py.js", "a/b.go", "b.d/x.rs", "b.d/x", "a/index.ts", "b.d"]
    stem = lambda p: re.sub(r"\.[^./]+$", "", p)
    for files in (names, names[1:], names[3:], names[::2], names[::-3]):
        ranked = lambda p: [i for e in mt.MODULE_ENDINGS for i, f in enumerate(files) if f == p + e] + [i for i, f in enumerate(files) if stem(f) == p]
        want = {p: next(iter(ranked(p)), None) for p in [*names, "none"]}
        table = spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(99, None)], "file_id long, path string")
        asked = spark.createDataFrame([(p, k) for p in want for k in (1, 1)] + [(None, 2)], "at string, k int")
        got = mt.resolved_paths(asked, table, "at")
        assert got.columns == ["at", "k", "imported_file_id"]
        assert sorted((r.at or "-", r.imported_file_id or 0) for r in got.collect() if r.k == 1) == sorted((p or "-", i or 0) for p, i in want.items() for _ in (1, 2))
        assert got.where("k = 2").first().imported_file_id is None
