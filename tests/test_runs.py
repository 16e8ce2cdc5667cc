from pyspark.sql import functions as F

from lithic.operators import dependencies as dp
from lithic.operators import runs as rn
from lithic.operators import search as se
from lithic.sources import scan
from lithic.streaming import progress as pg


def test_folds_of_null_keys_and_empty_tables(spark):
    kind = "key long, id long, at double, failed boolean"
    events = spark.createDataFrame([(None, i, 0.0, True) for i in range(7)] + [(1, 9, 0.0, True)], kind)
    granted = {(r.key, r.id): r.granted for r in pg.limited(events).collect()}
    assert [granted[None, i] for i in range(7)] == [True] * 5 + [False] * 2 and granted[1, 9]
    states = {(r.key, r.id): r.state for r in pg.broken(events).collect()}
    assert [states[None, i] for i in range(7)] == ["closed"] * 4 + ["open"] * 3 and states[1, 9] == "closed"
    assert pg.limited(events.where("false")).count() == pg.broken(events.where("false")).count() == 0


def test_failures_expire_together_and_clear(spark):
    rows = [("r", "AD", 0.0, 1), ("r", "DP", 100.0, 2), ("r", "DP", 150.0, 3), ("r", "ET", 300.0, 4), ("s", "AD", 0.0, 5)]
    failed = spark.createDataFrame(rows, "repo string, category string, at double, n long")
    cleared = spark.createDataFrame([("r", "ET", 310.0, 6), ("r", "DP", 120.0, 7)], "repo string, category string, at double, n long")
    at = lambda now, ttl: sorted((r.repo, r.category, r.n) for r in rn.failed_nodes(failed, cleared, "repo", "category", "at", "n", F.lit(now), ttl).collect())
    assert at(320.0, 400.0) == [("r", "AD", 1), ("r", "DP", 3), ("s", "AD", 5)]
    assert at(320.0, 200.0) == [("r", "AD", 1), ("r", "DP", 3)]
    assert at(320.0, 99.0) == []  # only the stretch from 300 is left, and it is cleared
    assert at(500.0, 199.0) == []


def test_progress_ends_with_the_task(spark):
    rows = [(1, "SCANNING", 0.0, 0), (2, "SCANNING", 0.0, 5), (3, "PARSING", 10.0, 5), (4, "PARSING", 10.0, 5), (5, "COMPLETED", 100.0, 5), (6, "FAILED", 100.0, 5)]
    events = spark.createDataFrame([("t", *r) for r in rows], "task string, n int, step string, percent double, total int")
    told = pg.reported(events, ["task"], ["n"], "step", "percent", "total")
    assert sorted((r.n, r.event) for r in told.collect()) == [(3, "progress"), (5, "complete"), (5, "progress")]


def test_dependencies_of_imports_and_objects(spark):
    rows = [("org.junit.Test", "A.kt"), ("'next/router'", "a.jsx"), ("nextjs", "a.ts"), ("numpy.linalg", "a.py"), ("numpy", "a.go"), (None, "a.py")]
    df = spark.createDataFrame(rows, "name string, path string")
    assert [r[0] for r in df.select(dp.seeded_import(F.col("name"), F.col("path"))).collect()] == ["junit", "next", None, "numpy", None, None]
    objects = spark.createDataFrame([("Core", "a.vue"), ("persistence", "A.java"), ("core", "a.py")], "name string, path string")
    found = [r[0] for r in objects.select(dp.seeded_object(F.col("name"), F.col("path"))).collect()]
    assert found == ["@angular/core", "spring-boot-starter-data-jpa", None]


def test_search_without_words_finds_nothing(spark):
    rows = spark.createDataFrame([(1, "a b", 0.5), (2, "b", 0.9), (3, "b", None)], "id long, text string, c double")
    index = se.postings(rows, "id", ["text"])
    assert se.matches(rows, index, " ?!", "id").collect() == []
    assert [r.id for r in se.result_page(se.matches(rows, index, "B a", "id"), "c", "id").collect()] == [1, 2, 3]
    assert [r.id for r in se.result_page(se.matches(rows, index, "b", "id", {"c": 0.9}), "c", "id").collect()] == [2]


def test_manifests_above(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    for name in ("pom.xml", "package.json"):
        (tmp_path / "a" / name).write_text("")
    assert [p.rsplit("/", 1)[1] for p in scan.manifests_above(spark, str(deep))] == ["package.json", "pom.xml"]
    assert scan.manifests_above(spark, str(deep), levels=2) == scan.manifests_above(spark, str(deep / "none")) == []
