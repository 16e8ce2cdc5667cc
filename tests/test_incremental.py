"""Propagation of changes, node tables that follow their files, tables of parts under manifests."""

import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import incremental as inc
from lithic.sources import parsers
from lithic.sources.tableset import Put, TableSet, bucket


def reach(spark, files, nodes=(), calls=(), imports=(), changed=(), **more):
    frame = spark.createDataFrame
    found = inc.propagated(
        frame([(f,) for f in files], "file_id string"), frame(list(nodes), "id string, file_id string"), frame(list(calls), "caller_node_id string, callee_node_id string"),
        frame(list(imports), "importer_file_id string, imported_file_id string"), frame(list(changed), "file_id string, change string"), **more,
    )
    return {r.file_id: (r.depth, r.kinds) for r in found.collect()}


NODES = [(f"n{f}", f) for f in "abcd"]


@pytest.mark.parametrize(
    "calls, imports, changed, more, expected",
    [
        ([], [], [("a", "modified")], {}, {}),  # no edges
        ([("nb", "na")], [], [("a", "modified")], {}, {"b": (1, ["caller"])}),
        ([("na", "nb")], [], [("a", "modified")], {}, {"b": (1, ["callee"])}),
        ([("na", "nb"), ("nb", "nc")], [], [("a", "modified")], {"depth": 1}, {"b": (1, ["callee"])}),  # the depth holds
        ([("na", "nb"), ("na", "nc")], [], [("a", "modified")], {}, {"b": (1, ["callee"]), "c": (1, ["callee"])}),  # each file once
        ([], [("b", "a")], [("a", "modified")], {}, {"b": (1, ["importer"])}),
        ([], [("a", "b")], [("a", "added")], {}, {"b": (1, ["importee"])}),
        ([("nb", "na")], [("c", "a")], [("a", "modified")], {}, {"b": (1, ["caller"]), "c": (1, ["importer"])}),
        ([("na", "nb"), ("nb", "na")], [], [("a", "modified")], {}, {"b": (1, ["callee", "caller"])}),  # a cycle ends
        ([("nowhere", "na"), ("na", None)], [("a", None)], [("a", "modified")], {}, {}),  # ends that are not there
        ([("na", "nb")], [], [("a", "deleted")], {}, {}),  # what is deleted starts nothing
        ([("na", "nb")], [], [], {}, {}),
        ([("na", "nb"), ("nb", "nc"), ("nc", "nd")], [], [("a", "modified")], {}, {"b": (1, ["callee"]), "c": (2, ["callee"]), "d": (3, ["callee"])}),
        ([("na", "nb")], [("c", "b"), ("d", "c")], [("a", "modified")], {"depths": {"importer": 2}}, {"b": (1, ["callee"]), "c": (2, ["importer"])}),
        ([("na", "nb"), ("na", "nb")], [], [("a", "modified"), ("a", "modified"), ("b", "added")], {}, {}),  # changed files are not among the reached
    ],
)
def test_propagation(spark, calls, imports, changed, more, expected):
    assert reach(spark, "abcd", NODES, calls, imports, changed, **more) == expected


def test_files_that_are_gone_lead_no_further(spark):
    got = reach(spark, "acd", NODES, [("na", "nb"), ("nb", "nc")], [], [("a", "modified")])
    assert got == {"b": (1, ["callee"])}


def test_propagation_over_a_random_graph(spark):
    rng = random.Random(3)
    files = [f"f{i}" for i in range(60)]
    nodes = [(f"n{i}", rng.choice(files)) for i in range(150)]
    calls = [(f"n{rng.randrange(160)}", f"n{rng.randrange(160)}") for _ in range(50)] + [("n0", f"n{i}") for i in range(20)]
    imports = [(rng.choice(files), rng.choice(files)) for _ in range(15)]
    changed = [("f1", "modified"), ("f2", "added"), ("f3", "deleted")]
    of, alive = dict(nodes), set(files) - {"f9", "f3"}
    steps = {(of[a], of[b]) for a, b in calls if a in of and b in of} | set(imports)
    steps |= {(b, a) for a, b in steps}
    depth = {"f1": 0, "f2": 0}
    for k in (1, 2, 3):
        for a, b in sorted(steps):
            if depth.get(a) == k - 1 and a in alive:
                depth.setdefault(b, k)
    got = reach(spark, alive, nodes, calls, imports, changed)
    assert {f: d for f, (d, _) in got.items()} == {f: d for f, d in depth.items() if d}


def code(i, size):
    return f"import os\n\nclass C{i}:\n    def m(self, a={size}):\n        return os.path.join(a)\n\n\ndef f_{i}(b):\n    return C{i}().m({size})\n"


def frame(spark, files):
    return spark.createDataFrame([(f"src/m{i}.py", "python", text) for i, text in sorted(files.items())], "path string, language string, content string")


def same(spark, table, files):
    got, whole = table.nodes(), parsers.nodes(frame(spark, files))
    assert sorted(map(repr, got.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_updates_equal_a_full_parse(spark, tmp_path):
    rng = random.Random(8)
    files = {i: code(i, 0) for i in range(120)}
    table = inc.NodeTable(spark, str(tmp_path / "t"), 40)
    assert table.update(frame(spark, files)).full
    for edit in range(3):
        before = {f for own in table.tables.manifest()["tables"]["nodes"]["parts"].values() for f in own}
        for i in rng.sample(sorted(files), 4):
            files[i] = code(i, 10 + edit)
        del files[rng.choice(sorted(files))]
        files[200 + edit] = code(200 + edit, 1) if edit else "def broken(:\n"
        done = table.update(frame(spark, files))
        assert (done.added, done.deleted, done.full) == (1, 1, False) and done.modified in (3, 4) and done.parts <= 6 < done.of_parts
        same(spark, table, files)
        after = {f for own in table.tables.manifest()["tables"]["nodes"]["parts"].values() for f in own}
        assert len(before - after) <= done.parts and len(after & before) >= 30  # other parts are the same files
    version = table.tables.manifest()["version"]
    assert table.update(frame(spark, files)).version == version  # nothing changed, nothing committed


def test_reads_of_parts_touch_only_their_files(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    rows = spark.range(1000).withColumn("text", F.col("id").cast("string"))
    tables.commit([Put("x", rows, bucket("id", 16), order=["id"])])
    part = tables.read("x", ["3", "7", "99"])
    assert {f.split("_part=")[1].split("/")[0] for f in part.inputFiles()} == {"3", "7"}
    assert {r.id for r in part.collect()} == {r.id for r in rows.where(bucket("id", 16).isin("3", "7")).collect()}


def test_many_changes_parse_everything(spark, tmp_path):
    files = {i: code(i, 0) for i in range(10)}
    table = inc.NodeTable(spark, str(tmp_path / "t"), 8)
    table.update(frame(spark, files))
    files |= {i: code(i, 1) for i in range(3)}
    assert not table.update(frame(spark, files)).full  # three of ten are not over 30 %
    files |= {i: code(i, 2) for i in range(4)}
    assert table.update(frame(spark, files)).full
    same(spark, table, files)
    assert table.update(frame(spark, {}), full_ratio=99).deleted == 10 and table.nodes().count() == 0
    table.update(frame(spark, files))
    same(spark, table, files)


def test_an_update_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    files = {i: code(i, 0) for i in range(20)}
    table = inc.NodeTable(spark, str(tmp_path / "t"), 8)
    table.update(frame(spark, files))
    changed = files | {3: code(3, 5)}

    def dies(self, manifest):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(TableSet, "_publish", dies)
        with pytest.raises(OSError):
            table.update(frame(spark, changed))
    again = inc.NodeTable(spark, str(tmp_path / "t"), 8)
    same(spark, again, files)
    assert again.update(frame(spark, changed)).modified == 1
    same(spark, again, changed)
    assert again.tables.vacuum() > 0
    same(spark, again, changed)


def test_versions_and_writers(spark, tmp_path):
    a, b = TableSet(spark, str(tmp_path / "t")), TableSet(spark, str(tmp_path / "t"))
    put = lambda rows, mode="all", parts=(): Put("x", spark.createDataFrame(rows, "k string, n int"), F.col("k"), mode, parts)
    assert a.commit([put([("a/b =c", 1), ("z", 2)])], {"why": "first"}) == 1
    assert b.commit([put([("z", 3)], "parts", ["z"])]) == 2 and b.commit([put([("z", 4)], "append")]) == 3
    assert sorted(map(tuple, a.read("x").collect())) == [("a/b =c", 1), ("z", 3), ("z", 4)]
    assert sorted(map(tuple, a.read("x", version=1).collect())) == [("a/b =c", 1), ("z", 2)]
    with pytest.raises(ValueError):
        a.commit([put([("y", 1)], "parts", ["z"])])
    stale = a.manifest()
    b.commit([], drop={"x": ["z"]})
    a.manifest = lambda version=None: stale
    with pytest.raises(RuntimeError):
        a.commit([put([("late", 1)], "append")])
    assert b.manifest()["note"] == {"why": "first"} and [r.n for r in b.read("x").collect()] == [1]
    assert b.rollback(2) == 5 and sorted(r.n for r in b.read("x").collect()) == [1, 3]
    assert b.read("x", []).count() == 0
