from pyspark.sql import functions as F

from lithic.operators import hierarchy, tables
from lithic.operators import views as v


def test_calls_with_what_they_call(spark):
    nodes = spark.createDataFrame([("a", "function", "f", "x.py"), ("b", "method", "g", "y.py"), ("c", "class", "K", "z.py")], "id string, node_type string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b", 9, 0), ("a", None, 3, 0), ("a", "gone", 3, 4), ("b", "c", 1, 0), ("b", "a", 1, 0)], "caller_node_id string, callee_node_id string, start_line int, start_column int")
    got = sorted((r.caller_node_id, r["at"], r.callee_node_id, r.callee_name, r.callee_path) for r in v.call_list(edges, nodes).collect())
    assert got == [("a", 1, None, None, None), ("a", 2, "gone", None, None), ("a", 3, "b", "g", "y.py"), ("b", 1, "a", "f", "x.py"), ("b", 2, "c", "K", "z.py")]
    assert {r.caller_node_id for r in v.call_list(edges, nodes, ["method", "class"]).collect()} == {"b"} and v.call_list(edges, nodes, []).count() == 0


def test_links_of_files(spark):
    files = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "file_id string, path string")
    imports = spark.createDataFrame([("1", "2"), ("1", "2"), ("1", "3"), ("3", "3"), ("2", None), ("9", "1")], "importer_file_id string, imported_file_id string")
    assert {r.path: (r.imports, r.importers) for r in v.file_links(imports, files).collect()} == {"a": (["b", "c"], []), "b": ([], ["a"]), "c": ([], ["a"])}


def test_filters_of_lists(spark):
    routes = spark.createDataFrame([("get", "/Users/{id}", "flask"), ("POST", "/users", "flask"), ("GET", "/x", "gin")], "http_method string, path_pattern string, framework string")
    shown = lambda *a: sorted(r.path_pattern for r in v.route_list(routes, *a).collect())
    assert shown("USER") == ["/Users/{id}", "/users"] and shown(None, "Get") == ["/Users/{id}", "/x"] and shown("user", "post", ["gin"]) == [] and len(shown()) == 3
    (row,) = [r for r in v.route_summary(routes, "framework").collect() if r.framework == "flask"]
    assert (row.n, row.frameworks, row.methods) == (2, ["flask"], ["GET", "POST"])
    patterns = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.4)], "framework string, confidence double")
    assert [r.framework for r in v.confident(patterns, 0.5).collect()] == ["a"] and v.confident(patterns).count() == 3
    deps = spark.createDataFrame([("npm", "dev", "b", None, "p"), ("npm", "dev", "a", "g", "p"), ("npm", "dev", "a", None, "p"), ("pip", "dev", "c", None, "p"), ("npm", "compile", "z", None, "p")], "ecosystem string, scope string, artifact_name string, group_name string, path string")
    assert sorted((r["at"], r.artifact_name, r.group_name) for r in v.dependency_list(deps, "npm", "dev").collect()) == [(1, "a", None), (2, "a", "g"), (3, "b", None)]
    assert v.camel(deps).columns == ["ecosystem", "scope", "artifactName", "groupName", "path"] and v.exists(deps) and not v.exists(deps.where("false"))


def test_points_of_parallel_steps(spark):
    schema = "branch string, title string, n int"
    before = spark.createDataFrame([("grow", "a", 1), ("grow", None, 2), ("update", "a", 3), ("update", "b", 4), ("idle", "a", 5)], schema)
    new = spark.createDataFrame([("grow", "a", 10), ("grow", "b", 11), ("grow", None, 12), ("update", "a", 13), ("first", "x", 14)], schema)
    assert sorted(r.n for r in v.merged_points(before, new, "branch").collect()) == [1, 2, 5, 11, 12, 13, 14]
    assert v.merged_points(before, new.limit(0), "branch").count() == 5 and v.merged_points(before.limit(0), new, "branch").count() == 5


def test_points_are_checked(spark):
    rows = [("DP", "DP-Factory", "t", "d", 0.5), ("DP-", "DP-", "", None, 1.5), (None, "XX-a", "t", "d", float("nan")), ("TK", "DK-x", "t", "d", None)]
    found = tables.with_errors(spark.createDataFrame(rows, "category string, prefix string, title string, description string, confidence double"), v.point_checks()).collect()
    assert [r.errors for r in found] == [[], ["category", "prefix", "title", "description", "confidence"], ["category", "prefix", "confidence"], []]


def test_costs_and_names(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 2_000_000), ("free", 5, 5), ("m", None, 1_000_000)], "model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 3.0), ("m", 2.0, 3.0)], "model string, input double, output double")
    assert [round(r.cost, 9) for r in v.call_costs(calls, prices).orderBy("model", F.desc("prompt_tokens")).collect()] == [0.0, 8.0, 3.0]
    names = spark.createDataFrame([("*.use", "app.use(x)", 3), ("*.use (y)", "*.use", 4), ("*.use", None, 5), ("addInterceptors(r)", "", 6)], "n string, q string, line int")
    assert [r.x for r in names.select(v.middleware_name(F.col("n"), F.col("q"), F.col("line")).alias("x")).collect()] == ["app.use(x)", "middleware_at_line_4", "middleware_at_line_5", "addInterceptors"]


def test_descendants_and_versions(spark):
    spans = [("f", i, None, a, None, b, None) for i, (a, b) in enumerate([(1, 9), (2, 5), (3, 4), (6, 8), (10, 11)])]
    tree = hierarchy.tree(spark.createDataFrame(spans, "file_id string, id long, parent_id long, start_line int, start_column int, end_line int, end_column int"))
    asked = spark.createDataFrame([("f", 0), ("f", 1), ("f", 4), ("g", 0), ("f", 0)], "file_id string, id long")
    assert sorted((r.ancestor, r.id) for r in v.descendants(tree, asked).collect()) == [(0, 1), (0, 2), (0, 3), (1, 2)]
    snapshots = spark.createDataFrame([("v1", "storing", "1", "h"), ("v2", "storing", "1", "i"), ("v2", "storing", None, "j"), ("v3", "parsing", "1", "k")], "analysis_version string, stage string, file_id string, content_hash string")
    assert [tuple(r) for r in v.latest_snapshot(snapshots, "storing").collect()] == [("v2", "1", "i")] and v.latest_snapshot(snapshots, "none").count() == 0
    rows = spark.createDataFrame([("r", "v1", 1, "failed"), ("r", "v2", 3, "completed"), ("r", "v2", 2, "completed"), ("r", "v3", 3, "running"), ("q", "v1", 1, "failed")], "repo string, version string, at_time int, status string")
    assert sorted((r.repo, r["at"], r.version, r.last_at) for r in v.version_list(rows, ["repo"], "version", "at_time", 2).collect()) == [("q", 1, "v1", 1), ("r", 1, "v3", 3), ("r", 2, "v2", 3)]
    assert sorted((r.repo, r.version) for r in v.latest_of_status(rows, ["repo"], "at_time", "version", ["completed", "failed"]).collect()) == [("q", "v1"), ("r", "v2")]
    assert sorted((r.repo, r.version) for r in v.latest_of_status(rows, ["repo"], "at_time", "version").collect()) == [("q", "v1"), ("r", "v3")]
    changed = spark.createDataFrame([("a", "modified"), ("b", "deleted")], "path string, change string")
    assert sorted(r.path for r in v.to_analyse(changed, spark.createDataFrame([("a",), ("c",)], "path string"), "path").collect()) == ["a", "c"]
