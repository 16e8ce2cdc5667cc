"""What can be added to by a caller, and small operators around it."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lithic.functions import jsons
from lithic.operators import evaluation, frameworks, graphs, hooks, ingest
from lithic.sources import manifests, parsers


def test_a_parser_of_another_language(spark):
    mine = parsers.PARSERS.copy()
    mine.add(99, "ini", lambda path, text: [parsers._row(path, "ini", "variable", line.split("=")[0], None, (n, n, 0, len(line))) for n, line in enumerate(text.split("\n"), 1)])
    files = spark.createDataFrame([("a.ini", "ini", "x=1\ny=2"), ("b.py", "python", "def f():\n    pass\n"), ("c.zz", "zz", "?")], "path string, language string, content string")
    assert sorted((r.language, r.name, r.start_line) for r in parsers.nodes(files, mine).collect()) == [("ini", "x", 1), ("ini", "y", 2), ("python", "f", 1)]
    assert [r.language for r in parsers.nodes(files).collect()] == ["python"]


def test_a_manifest_of_another_kind(spark):
    mine = manifests.PARSERS.copy()

    def composer(files):
        found = files.where(F.endswith("path", F.lit("composer.json"))).select("path", F.explode(F.from_json(F.get_json_object("content", "$.require"), "map<string,string>")).alias("artifact_name", "version_range"))
        return found.select("path", F.lit("composer").alias("ecosystem"), F.lit(None).cast("string").alias("group_name"), "artifact_name", F.lit(None).cast("string").alias("version"), "version_range", F.lit("compile").alias("scope"), F.lit(0).alias("at"))

    mine.add(5, "composer", composer)
    files = spark.createDataFrame([("composer.json", json.dumps({"require": {"monolog/monolog": "^3"}})), ("requirements.txt", "flask==2\n")], "path string, content string")
    assert sorted((r.ecosystem, r.artifact_name) for r in manifests.dependencies(files, mine).collect()) == [("composer", "monolog/monolog"), ("pip", "flask")]


def test_taggers_routes_and_kinds_of_middleware(spark):
    nodes = spark.createDataFrame([("1", "ruby", "method", "show", ["before_action"], ["own"], ""), ("2", "java", "class", "A", ["@Controller"], None, "")], "id string, language string, node_type string, name string, annotations array<string>, tags array<string>, signature string")
    mine = frameworks.TAGGERS.copy()
    mine.add(60, "ruby", lambda: F.when(F.array_contains("annotations", "before_action"), F.array(F.lit("rails-controller"))), languages=("ruby",))
    assert {r.id: r.tags for r in frameworks.tagged(nodes, mine).collect()} == {"1": ["own", "rails-controller"], "2": ["http-controller"]}
    calls = spark.createDataFrame([("*.use", "app.use(tracer())", "f", 1, "javascript")], "name string, qualified_name string, file_path string, start_line int, language string")
    assert [r.kind for r in frameworks.middleware(calls, frameworks.MIDDLEWARE_KINDS | {"trace": "tracing"}).collect()] == ["tracing"]
    ways = frameworks.ROUTES.copy()
    for name in ("annotations", "express", "configurations"):
        ways.remove(name)
    ways.add(1, "files", lambda nodes, calls, files: files.select(F.lit("GET").alias("http_method"), F.concat(F.lit("/"), "path").alias("path_pattern")))
    assert [r.path_pattern for r in frameworks.routes(nodes, calls, spark.createDataFrame([("pages/x",)], "path string"), ways).collect()] == ["/pages/x"]


def test_matchers_by_name(spark):
    point = "struct<category: string, title: string, aliases: array<string>, lines: array<int>, vector: array<double>>"
    rows = [
        (("DP", "Observer", ["Listener"], [1, 2, 3], [1.0, 0.0]), ("DP", "listener", None, [50], [0.0, 1.0])), (("DP", "Factory", None, [1, 2, 3], [1.0, 0.0]), ("DP", "zzz", None, [1, 2], [0.0, 1.0])),
        (("DP", "Proxy", None, [9], [1.0, 0.1]), ("DP", "qqq", None, [1], [1.0, 0.0])), (("DP", "Same", None, [1], [1.0, 0.0]), ("AD", "Same", None, [1], [1.0, 0.0])), ((None, "Same", None, [1], None), (None, "Same", None, [1], None)),
    ]
    pairs = spark.createDataFrame(rows, f"expected {point}, found {point}")
    found = lambda names, **more: sorted(r.expected.title for r in evaluation.matched(pairs, names, **more).collect())
    assert found(["title"]) == ["Observer"] and found(["lines"]) == ["Factory"] and found(["semantic"]) == ["Proxy"] and found(["title", "lines", "semantic"]) == ["Factory", "Observer", "Proxy"]
    mine = evaluation.MATCHERS.copy()
    mine.add(40, "first letter", lambda: F.substring("expected.title", 1, 1) == F.upper(F.substring("found.title", 1, 1)))
    assert found(["first letter"], matchers=mine) == []


def test_expansions(spark):
    points = spark.createDataFrame([("a", "d", "DP", 0.9, "old"), ("b", "d", "DP", 0.3, None), ("c", None, "AD", None, "kept"), ("boom", "", "AD", 0.8, "stays"), (None, None, None, 0.9, None)], "title string, description string, category string, confidence double, expansion string")

    def expand(row):
        if row["title"] == "boom":
            raise ValueError
        return None if row["title"] == "c" else f"more on {row['title']}"

    got = {r.title: (r.expansion, r.expansion_failed) for r in hooks.expanded(points, expand).collect()}
    assert got == {"a": ("more on a", False), "b": ("more on b", False), "c": ("kept", True), "boom": ("stays", True), None: (None, True)}
    high = {r.title: (r.expansion, r.expansion_failed) for r in hooks.expanded(points, expand, 0.7).collect()}
    assert high["b"] == (None, False) and high["c"] == ("kept", False) and high["a"] == ("more on a", False)


def test_synthetic_nodes_and_summaries(spark):
    cases = spark.createDataFrame([("c1", "java", [("a/B.java", 3, 9), ("x\\y.java", 1, 2)]), ("c2", "vue", [("v.vue", 1, 5)]), ("c3", "go", [])], "id string, language string, code_snippets array<struct<file: string, start_line: int, end_line: int>>")
    got = sorted((r.case_id, r.id, r.node_type, r.name, r.start_line, r.end_line) for r in evaluation.synthetic_nodes(cases).collect())
    assert got == [("c1", "0", "file", "a_B.java", 3, 9), ("c1", "1", "file", "x_y.java", 1, 2), ("c2", "0", "script", "v.vue", 1, 5)]
    results = spark.createDataFrame([("A", 1.0, 1.0, 1.0, 2, 2, 0.5), ("A", 0.33333, 0.5, 0.25, 1, 4, 0.7), ("B", 0.5, 0.5, 0.5, 1, 1, 0.9)], "category string, f1 double, precision double, recall double, extracted long, expected long, confidence double")
    rows = {r.category: r for r in evaluation.category_summary(results).collect()}
    assert (rows["A"].f1, rows["A"].cases, rows["A"].expected) == (0.6667, 2, 6) and (rows[None].f1, rows[None].cases, rows[None].precision) == (0.5833, 3, None)
    assert [(r.category, r.f1, r.cases) for r in evaluation.category_summary(results.limit(0)).collect()] == [(None, 0.0, 0)]


def test_listings_put_folders_first(spark):
    files = spark.createDataFrame([("b.txt",), ("A.txt",), ("zoo/x",), ("Bar/y/z",), ("bar.txt",)], "path string")
    rows = graphs.listing(graphs.folder_tree(files, "path")).collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.at) if r.parent == ""] == ["Bar", "zoo", "A.txt", "b.txt", "bar.txt"]


def test_dry_runs_write_nothing(spark, tmp_path):
    edges = spark.range(7)
    assert ingest.rebuilt(edges, str(tmp_path / "e"), dry_run=True) == 7 and not (tmp_path / "e").exists()
    assert ingest.rebuilt(edges, str(tmp_path / "e")) == 7 and ingest.rebuilt(edges.limit(2), str(tmp_path / "e")) == 2 and spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_nested_methods_and_long_files_in_linear_time():
    text = "export class A {\n  @Input()\n\n  @Get('/x')\n  run(a) {\n    const o = { deep(b) {\n      return '}' + \"{\"; // }\n    } };\n  }\n}\n"
    rows = {(r[3], r[4]): r for r in parsers.parse_by_pattern("a.ts", "typescript", text)}
    assert rows["class", "A"][6:8] == (1, 10) and rows["method", "run"][6:8] == (5, 9)
    many = "".join(f"class C{i} {{\n  run{i}() {{\n    call{i}();\n  }}\n}}\n" for i in range(6000))
    began = time.time()
    assert len(parsers.parse_by_pattern("b.ts", "typescript", many)) >= 12_000
    assert time.time() - began < 20
    broken = '{"a": "' + 'say "x" and ' * 20_000 + '"}'
    began = time.time()
    assert json.loads(jsons.repaired(broken))["a"].count('"x"') == 20_000
    assert time.time() - began < 10


@pytest.mark.parametrize("lang", ["javascript", "java", "go"])
def test_unclosed_braces_end_with_the_file(lang):
    text = {"javascript": "function f(a) {\n  if (a) {\n", "java": "class A {\n  public void f() {\n", "go": "func f(a int) {\n  if a > 0 {\n"}[lang]
    rows = [r for r in parsers.parse_by_pattern("x", lang, text) if r[4] == "f"]
    assert rows and rows[0][7] >= 2
