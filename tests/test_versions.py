from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lithic.operators.versions import Versions
from lithic.sources.tableset import TableSet

POINTS = "version string, category string, id long, title string, files array<string>"
AT = [datetime(2024, 1, d) for d in range(1, 9)]


def files(spark, **edits):
    return spark.createDataFrame([(f"f{i}", edits.get(f"f{i}", "h")) for i in range(10) if edits.get(f"f{i}", "h")], "path string, content_hash string")


@pytest.fixture
def versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    v.create("v1", AT[0])
    points = [(None, c, 10 * k + i, f"{c}{i}", [f"f{i}"]) for k, c in enumerate(("DP", "AD")) for i in range(10)]
    v.complete("v1", spark.createDataFrame(points, POINTS), files(spark), AT[1])
    return v


def titles(frame):
    return sorted((r.category, r.title) for r in frame.collect())


def redone(title):
    return lambda asked: asked.select(F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("category"), F.lit(99).cast("long").alias("id"), F.concat(F.lit(title), "path").alias("title"), F.array("path").alias("files"))


def test_a_retry_replaces_only_what_changed(spark, versions):
    now = files(spark, f3="new", f4=None)
    assert versions.retry("DP", now, redone("x"), AT[2])["status"] == "skipped"
    spark_status = versions.record("v1")["agent_status"]["DP"]
    assert (spark_status["status"], spark_status["attempts"], spark_status["points"]) == ("success", 1, 10)
    # as after a run in which the category failed
    failed = versions.retry("DP", now, lambda asked: redone("x")(asked).limit(0), AT[2], force=True)
    assert failed["status"] == "failed" and titles(versions.points(failed["version"])) == titles(versions.points("v1"))
    seen = []
    result = versions.retry("DP", files(spark, f3="new", f4=None, f5="newer"), lambda asked: (seen.append({r.path for r in asked.collect()}), redone("x")(asked))[1], AT[3], reach=lambda paths: spark.createDataFrame([("f6",)], "path string"))
    assert seen == [{"f5", "f6"}] and result == {"status": "success", "version": "v1-retry-DP-retry-DP", "points": 2, "full": False}
    got = titles(versions.points(result["version"]))
    assert got == sorted([("AD", f"AD{i}") for i in range(10)] + [("DP", f"DP{i}") for i in range(10) if i not in (5, 6)] + [("DP", "xf5"), ("DP", "xf6")])
    status = versions.record(result["version"])["agent_status"]
    assert (status["DP"]["attempts"], status["DP"]["status"], status["AD"]["attempts"]) == (3, "success", 1)
    assert versions.latest_completed()["version"] == result["version"] and versions.record(result["version"])["parent"] == "v1-retry-DP"


def test_a_retry_that_dies_leaves_the_old_version(spark, versions, monkeypatch):
    before = titles(versions.points("v1"))

    def dies(asked):
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        versions.retry("DP", files(spark, f3="new"), dies, AT[2], force=True)
    with monkeypatch.context() as m:
        m.setattr(TableSet, "_publish", lambda *_: dies(None))
        with pytest.raises(RuntimeError):
            versions.retry("DP", files(spark, f3="new"), redone("x"), AT[2], force=True)
    again = Versions(spark, versions.tables.folder)
    assert titles(again.points("v1")) == before and [r.version for r in again.records().collect()] == ["v1"]
    assert again.retry("DP", files(spark, f3="new"), redone("x"), AT[2], force=True)["points"] == 10


def test_many_changes_and_unknown_categories_ask_for_all_files(spark, versions):
    result = versions.retry("ET", files(spark, f1="new"), redone("e"), AT[2])
    assert result["points"] == 10 and len(titles(versions.points(result["version"]))) == 30
    assert versions.record(result["version"])["agent_status"]["ET"]["attempts"] == 1


def test_a_failed_version_drops_its_parts(spark, versions):
    versions.create("v2", AT[4], "v1")
    versions.complete("v2", versions.points("v1"), files(spark), AT[5])
    parts = lambda: versions.tables.manifest()["tables"]["points"]["parts"]
    assert set(parts()) == {"v1", "v2"}
    number = versions.tables.manifest()["version"]
    versions.end("v2", "failed")
    assert versions.tables.manifest()["version"] == number + 1 and set(parts()) == {"v1"} and versions.record("v2")["status"] == "failed"
    assert versions.points("v2").count() == 0 and versions.latest_completed()["version"] == "v1"
    versions.tables.vacuum()
    assert titles(versions.points("v1")) and versions.files("v1").count() == 10


def test_versions_shown_and_deleted(spark, versions):
    versions.create("v2", AT[4], "v1")
    for wrong in ("v2", "nowhere"):
        with pytest.raises(ValueError):
            versions.switch(wrong)
    with pytest.raises(ValueError):
        versions.create("v1", AT[5])
    versions.complete("v2", versions.points("v1").where("category = 'AD'"), files(spark), AT[5])
    assert versions.current() == "v2"
    versions.switch("v1")
    assert versions.current() == "v1" and [r.version for r in versions.records().collect()] == ["v2", "v1"]
    with pytest.raises(ValueError):
        versions.delete("v1")
    versions.delete("v2")
    assert versions.record("v2") is None and versions.points("v2").count() == 0
