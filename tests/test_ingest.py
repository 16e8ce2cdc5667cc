from pyspark.sql import functions as F

from lithic.operators import hooks, ingest
from lithic.sources.tableset import TableSet


def test_ingestion_counts_and_keeps_the_first(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "", 1), (3, "c", 1)], "k long, name string, at int")
    checks = {"blank": F.col("name") == ""}
    counts = ingest.ingest(rows, checks, ["k"], [F.asc("at")], str(tmp_path / "t"))
    assert (counts.seen, counts.invalid) == (4, 1)
    assert sorted((r.k, r.name) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "b"), (3, "c")]
    assert [r.errors for r in ingest.refused(rows, checks).collect()] == [["blank"]]


def test_snapshots_replace_their_partition_only(spark, tmp_path):
    path = str(tmp_path / "s")
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    ingest.snapshot(files, "v1", "nodes", path)
    ingest.snapshot(files.limit(1), "v2", "nodes", path)
    ingest.snapshot(files.where("path = 'b'"), "v2", "nodes", path)
    assert [r.path for r in ingest.snapshot_of(spark, path, "v2", "nodes").collect()] == ["b"]
    assert ingest.snapshot_of(spark, path, "v1", "nodes").count() == 2


def test_stream_of_upserts(spark, tmp_path):
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]]):
        spark.createDataFrame(rows, "k long, v string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v string, at int").parquet(str(tmp_path / "in"))
        ingest.upsert_stream(stream, spark, str(tmp_path / "t"), ["k"], "at", str(tmp_path / "c")).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_upserts_rewrite_the_parts_they_touch(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    folders = lambda: {f for own in tables.manifest()["tables"]["rows"]["parts"].values() for f in own}
    run = lambda: ingest.upsert_parts(spark.readStream.schema("k long, v string, at int").parquet(str(tmp_path / "in")), spark, str(tmp_path / "t"), ["k"], "at", str(tmp_path / "c"), 16).awaitTermination()
    spark.createDataFrame([(k, "a", 5) for k in range(100)], "k long, v string, at int").write.parquet(str(tmp_path / "in"))
    run()
    before = folders()
    spark.createDataFrame([(7, "new", 6), (8, "late", 4), (9, "same", 5), (7, "old", 1)], "k long, v string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.k: r.v for r in tables.read("rows").collect()}
    assert len(got) == 100 and {k: v for k, v in got.items() if v != "a"} == {7: "new", 9: "same"} and len(before - folders()) <= 3
    version = tables.manifest()["version"]
    run()
    assert tables.manifest()["version"] == version and tables.manifest()["note"]["batch"] == 1


def test_hooks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b")], "t string, d string")

    def fails(_):
        raise ValueError

    assert hooks.embedded(rows, ["t", "d"], 3, lambda texts: [[1.0] for _ in texts]).first().embedding == [1.0, 0.0, 0.0]
    assert hooks.embedded(rows, ["t", "d"], 2, fails).first().embedding == [0.0, 0.0] and sum(hooks.embedded(rows, ["t", "d"], 4).first().embedding) == 2.0
    cases = spark.createDataFrame([("1", "DP", [("x",)])], "id string, category string, code_snippets array<struct<content:string>>")
    got = hooks.extracted(cases, lambda snippets, category: [{"title": snippets[0]["content"] + category}])
    assert [(r.case_id, r["at"], r.title, r.category) for r in got.collect()] == [("1", 0, "xDP", "DP")]
    files = spark.createDataFrame([("g", "a", "l1\nl2\nl3"), ("g", "b", "x")], "g string, path string, content string")
    assert [(r.path, r.content) for r in hooks.context(files, "g", 1, 5).collect()] == [("a", "l1")]
    ingest.report(rows, "json", str(tmp_path / "r"))
    ingest.report(rows, "history", str(tmp_path / "h"))
    ingest.report(rows, "console")
    assert spark.read.json(str(tmp_path / "r")).count() == spark.read.json(str(tmp_path / "h")).count() == 1
